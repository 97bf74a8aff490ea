import hashlib
import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from test_near_dups import brute

from cribra.llm import mixing, secrets
from cribra.llm.common import persist_shared


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents and what each stage makes of them."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, f in cp.STAGES:
        out.append(persist_shared(f(spark, out[-1], sf), "test"))
    return out


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes
    assert stages[-1].columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]


def test_language_keeps_documents_with_words(stages):
    before, after = dict(_rows(stages[0])), dict(_rows(stages[1]))
    assert all(before[i] == t for i, t in after.items())
    assert len(after) >= 0.99 * sum(bool(re.search(r"[^\W\d_]", t or "")) for t in before.values())


def test_one_of_each_group_stays(stages):
    rows = _rows(stages[1])
    want = {i for i, (_, _, kept) in brute(rows, 5, 80).items() if kept}
    assert sorted(_rows(stages[2])) == sorted(r for r in rows if r[0] in want)


def test_secrets_are_masked_and_the_rest_stays(stages):
    before, after = dict(_rows(stages[2])), dict(_rows(stages[3]))
    assert before.keys() == after.keys()
    for i, t in after.items():
        parts = t.split(secrets.MASK)
        at = 0
        for p in parts:
            at = before[i].index(p, at) + len(p)
        assert 'token = "' not in t or re.search(f'token = "{secrets.MASK}"', t)
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_mixture_comes_near_its_targets(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    docs = {r.doc_id: r for r in stages[3].collect()}
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert max(copies.values()) <= 3 and copies.keys() <= docs.keys()
    listed, taken, longest = Counter(), Counter(), Counter()
    for i, r in docs.items():
        listed[r.source] += size(r.text)
        taken[r.source] += size(r.text) * copies[i]
        longest[r.source] = max(longest[r.source], size(r.text))
    goal = mixing.targets(listed, [5, 2, 1], sum(listed.values()))
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in listed)


def test_ids_decode_to_the_texts(stages):
    want = Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in _rows(stages[4]))
    got = stages[5].collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_run_and_empty_table(spark, sf, stages, tmp_path):
    assert cp.run(spark, sf).count() == stages[-1].count()
    empty = str(tmp_path / "documents.parquet")
    stages[0].limit(0).write.parquet(empty)
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_every_stage(spark, make, monkeypatch):
    from cribra.llm import lang_id

    monkeypatch.setattr(lang_id, "STEPS", 60)
    schema = ("doc_id long, text string, lang string, source string, n_chars long, copies int, row string, "
              "score double, p string, digest string, slot int, component string, ids string")
    extra = (7, "r", 0.5, "p", "d", 1, "c", "i")
    text = "the quick brown fox jumps over the lazy dog while {} cats look on from the old stone wall"
    rows = [(i, text.format(i % 7) + f" number {i} " + "and so on " * (i % 5), "en", f"s{i % 3}", None, *extra)
            for i in range(30)]
    rows += [(100, None, "en", "s0", 3, *extra), (101, "", None, None, 0, *extra), (102, "12 34 !!", "en", "s1", 8, *extra),
             (None, "a text without an id that says something of its own", "en", None, 1, *extra),
             (103, "no language and no source are given for this one here", None, None, None, *extra),
             (1, rows[1][1], "en", "s1", None, *extra), (104, "long words follow " * 20_000, "en", "s2", 5, *extra),
             (105, 'the key is token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" keep it safe', "en", "s2", 77, *extra)]
    long = " ".join(f"word{i}" for i in range(80))
    rows += [(200 + i, f"{long} end{i}", "en", "s0", 1, *extra) for i in range(3)]
    docs = make(rows, schema)
    seen = []
    for name, stage in cp.STAGES[:-1]:
        docs = persist_shared(stage(spark, docs, ""), "odd")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        seen.append({r.doc_id: r for r in docs.collect()})
    language, near, secret, mixed = seen
    assert language.keys() == {r[0] for r in rows} - {100, 101, 102}
    named = {(i, r.text) for i, r in language.items() if i is not None}
    want = {i for i, (_, _, kept) in brute(sorted(named), 5, 80).items() if kept}
    assert near.keys() == want | {None} and 200 in want and not want & {201, 202}
    assert secret[105].text == f'the key is token = "{secrets.MASK}" keep it safe'
    assert secret[105].n_chars == len(secret[105].text) and secret[104].n_chars == 5
    assert mixed.keys() <= secret.keys() and all(tuple(r)[5:] == extra for r in mixed.values())
    ids = cp.STAGES[-1][1](spark, docs, "").collect()
    assert len(ids) == docs.count() and all(r.n_tokens == len(r.ids) for r in ids)
