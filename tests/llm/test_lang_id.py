import zlib

import numpy as np
import pytest

from cribra.llm import lang_id as L

SCHEMA = "doc_id long, text string, lang string, p string, score double"


def test_gradients_equal_differences():
    net = L.Network(3, hidden=4, dtype=np.float64)
    rng = np.random.default_rng(0)
    words = rng.integers(97, 105, (7, 5)).astype(np.uint8)
    langs = rng.integers(0, 3, 7)
    _, grad = net.gradients(words, langs)
    for k, p in net.p.items():
        for _ in range(8):
            i = tuple(rng.integers(0, s) for s in p.shape)
            if k[0] == "x":
                i = (int(rng.integers(97, 105)), *i[1:])
            old, loss = p[i], []
            for e in (1e-5, -1e-5):
                p[i] = old + e
                loss.append(net.gradients(words, langs)[0])
            p[i] = old
            assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(grad[k][i], abs=1e-7)


def test_word_table_equals_reading_every_byte(monkeypatch):
    monkeypatch.setattr(L, "CHUNK_CHARS", 50)
    monkeypatch.setattr(L, "WORD_TABLE", 5)
    net = L.Network(2, hidden=4)
    texts = ["ab cd ab", "", "x" * 500 + " é", "cd cd cd cd", "\ud800 a"]
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    r = L.Reader(net, ["l0", "l1"])
    got = [r.predict([t])[1][0] for t in texts]
    assert r.predict(texts)[1] == pytest.approx(got)
    for t, score in zip(texts, got):
        p = [net.label(np.frombuffer(x, np.uint8)[None])[:, 0] for w in t.split() for x in L._pieces(w.encode())]
        want = np.concatenate(p).mean(axis=0).max() if p else 0.0
        assert score == pytest.approx(want, abs=1e-5)


def test_held_out_accuracy_of_the_query(spark, sf):
    from cribra.llm.queries import op3_lang_id

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_lang_id(spark, sf).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) >= 0.9


def test_odd_rows(make, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 5)
    rows = [(i, "le chat est la" if i % 2 else "the cat is there", "fr" if i % 2 else "en", "", 0.0)
            for i in range(20)]
    odd = [(100, None, "en", None, 0.0), (101, "", None, "", 0.0), (102, "123 ### \n", "en", "", 0.0),
           (None, "le chat", None, "", 0.0), (103, "ü" * 400_000, "fr", "", 0.0), (1, "le chat est la", "fr", "", 0.0)]
    df = make(rows + odd, SCHEMA)
    got = L.identify(df).collect()
    assert len(got) == 26
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert by[None].held_out and by[None].lang_pred in ("en", "fr") and by[103].lang_pred in ("en", "fr")
    kept = L.keep_identified(df, 0.0)
    assert kept.columns == df.columns and kept.count() == 23
    assert L.identify(df.limit(0)).count() == 0
    unlabelled = L.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def _lexicon(rng, shared, n):
    """Words of a language: a tenth its own, the rest shared with its relatives."""
    own = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n // 10)]
    return own * 3 + shared[:n - len(own) * 3]


@pytest.mark.parametrize("n_langs", [2, 4, 30])
def test_cut_follows_the_learned_languages(make, n_langs):
    rng = np.random.default_rng(n_langs)
    # two and four languages are far apart; thirty share most of their words
    shared = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(60)]
    lex = [_lexicon(rng, shared, 60) if n_langs == 30 else
           ["".join(chr(97 + 6 * (k % 4) + c) for c in rng.integers(0, 6, 6)) for _ in range(60)]
           for k in range(n_langs)]
    say = lambda k, n: " ".join(rng.choice(lex[k], n))
    rows = [(k * 1000 + i, say(k, 120), f"l{k:02}", "", 0.0) for k in range(n_langs) for i in range(60)]
    if n_langs < 30:  # nobody can tell these
        rows += [(10 ** 6 + i, " ".join(w for ws in zip(*(rng.choice(lex[k], 40) for k in range(n_langs))) for w in ws),
                  None, "mixed", 0.0) for i in range(20)]
    df = make(rows, SCHEMA)
    kept = [r.p for r in L.keep_identified(df).collect()]
    assert kept.count("") >= 0.97 * 60 * n_langs
    assert kept.count("mixed") <= 5


def test_every_language_is_learned_and_too_many_raise(make, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 400)
    # 300 languages, each of its own three letters
    say = lambda k: " ".join(chr(0x4E00 + 3 * k + j % 3) * 2 for j in range(30))
    rows = [(300 * i + k, say(k), f"l{k:03}", "", 0.0) for k in range(300) for i in range(4)]
    df = make(rows, SCHEMA)
    net, langs = L.fit(df.select("doc_id", "text", "lang"))
    assert len(langs) == 300 and net.p["c"].shape == (300,)
    assert len({r.lang_pred for r in L.identify(df).collect()}) > 100
    monkeypatch.setattr(L, "SAMPLE_DOCS", 299)
    with pytest.raises(ValueError, match="languages"):
        L.fit(df.select("doc_id", "text", "lang"))
