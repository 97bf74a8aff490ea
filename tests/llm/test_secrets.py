import time

import numpy as np
import pytest

from cribra.llm import secrets as S

SCHEMA = "doc_id long, text string, n_chars int, score double, rule string, t string, h string"


@pytest.fixture(scope="module")
def judge(spark, sf):
    return S.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_held_out_findings(spark, sf):
    found, words = S.labelled_findings(spark.read.parquet(f"{sf}/documents.parquet"))
    cut = len(found) // 2
    judge = S.train(found[:cut], words)
    right = (judge.vote(found[cut:]) >= S.THRESHOLD) == np.array([f[3] for f in found[cut:]])
    assert right.mean() >= 0.97


def test_templates_that_training_never_saw(spark, sf):
    """Every template is held out once, with all its findings."""
    found, words = S.labelled_findings(spark.read.parquet(f"{sf}/documents.parquet"), 60)
    kinds = len(found) // 60
    assert len(found) == 60 * kinds
    right = []
    for fold in range(8):
        held = [f for i, f in enumerate(found) if i % kinds % 8 == fold]
        judge = S.train([f for i, f in enumerate(found) if i % kinds % 8 != fold], words)
        right += ((judge.vote(held) >= S.THRESHOLD) == np.array([f[3] for f in held])).tolist()
    assert np.mean(right) >= 0.8


def test_words_before_a_finding_are_learned():
    """The hand-written word patterns know nothing of these."""
    rng = np.random.default_rng(2)
    hexes = lambda: "".join(rng.choice(list("0123456789abcdef"), 32))
    found = [(f"the zorb {w} ", hexes(), "", int(w == "quil")) for w in ("quil", "mott", "frin") * 80]
    judge = S.train(found, frozenset())
    assert judge.odds["quil"] > 1 and abs(judge.odds["zorb"]) < 0.1 and judge.odds["mott"] < -1
    new = [(f"a zorb {w} ", hexes(), "", 0) for w in ("quil", "mott")]
    assert (judge.vote(new) >= S.THRESHOLD).tolist() == [True, False]


def _pem(body: str, head: str = "", kind: str = "RSA ") -> str:
    lines = "\n".join(body[i:i + 64] for i in range(0, len(body), 64))
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{head}{lines}\n-----END {kind}PRIVATE KEY-----"


def test_private_keys_are_masked_whole(make, judge):
    rng = np.random.default_rng(1)
    b64 = lambda n: "".join(rng.choice(list("ABCDEFabcdef0123456789+/"), n))
    locked = "Proc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,9A5D0F3E1C2B4A69\n\n"
    keys = [_pem(b64(20_000)), _pem(b64(400), locked), _pem(b64(1600), kind=""), _pem(b64(200)).replace("\n", "\r\n")]
    for key in keys:
        assert S.candidates(f"see {key} end")[0] == (4, 4 + len(key), "known")
    rows = [(i, f"before {k} after", 0, 0.0, "", "", "") for i, k in enumerate(keys)]
    df = make(rows, SCHEMA)
    assert {r.t for r in df.select(S.redacted(judge, df).alias("t")).collect()} == {f"before {S.MASK} after"}
    prose = "-----BEGIN PRIVATE KEY----- starts it, and so on. -----END PRIVATE KEY----- ends it"
    assert S.key_blocks(prose) == [(0, 27)]
    two = keys[1] + "\n" + keys[2]
    assert S.key_blocks(two) == [(0, len(keys[1])), (len(keys[1]) + 1, len(two))]


@pytest.mark.parametrize("unit", ["eyJ-", "eyJabcdefgh.", "-----BEGIN PRIVATE KEY-----", "eyJ_ab1-", "=", "xoxb-", "sk-a1 ",
                                  "-----BEGIN PRIVATE KEY-----\nA: b\n"])
def test_long_runs_take_linear_time(unit):
    text = (unit * (1_000_000 // len(unit) + 1))[:1_000_000]
    t = time.perf_counter()
    S.candidates(text)
    assert time.perf_counter() - t < 2


def test_forest_separates_and_keeps_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    f = S.Forest(20, 8, 3).fit(x[:400], y[:400])
    assert ((f.score(x[400:]) >= 0.5) == y[400:]).mean() > 0.85
    assert all(len(t[0]) <= 2 ** 9 for t in f.trees)
    same = S.Forest(3).fit(np.zeros((10, 2)), np.array([0, 1] * 5, float))
    assert same.score(np.zeros((1, 2)))[0] == pytest.approx(0.5, abs=0.3)


def test_candidates_do_not_overlap():
    text = 'token = "ghp_' + "a1" * 20 + '" key=' + "Z9" * 12 + " " + "q7" * 15 + " plainwordplainwordplainword"
    spans = S.candidates(text)
    assert [s[2] for s in spans] == ["known", "assigned", "mixed"]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert text[spans[0][0]:spans[0][1]] == "ghp_" + "a1" * 20


def test_scan_and_redact_odd_rows(make, judge):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    text = f'é😀 the token = "{secret}" and commit {secret} end'
    long = "word " * 60_000 + f'token = "{secret}"'
    rows = [(1, text), (2, None), (3, ""), (4, "see /usr/lib/some/file.so.1.2.3 or a.b@c.example.com"),
            (None, text), (1, text), (5, long), (6, "x" * 100_000 + "1")]
    df = make([(i, t, -1, 0.5, "r", "t", "h") for i, t in rows], SCHEMA)
    got = [r for r in S.scan(df, judge).collect() if r.is_secret]
    assert sorted((r.doc_id or 0, r.start, r.length) for r in got) == [
        (0, 16, 40), (1, 16, 40), (1, 16, 40), (5, 300_009, 40)]
    out = {(r.doc_id, r.text, r.n_chars) for r in S.redact(df).collect()}
    masked = text.replace(f'"{secret}"', f'"{S.MASK}"')
    assert S.redact(df).columns == df.columns
    assert (1, masked, len(masked)) in out and (2, None, -1) in out and (4, rows[3][1], -1) in out
    assert S.scan(df.limit(0), S.fit(df.limit(0))).count() == 0
    assert S.redact(df.limit(0)).count() == 0


def test_query_finds_the_assigned_tokens(spark, sf):
    from cribra.llm.queries import op7_secret_scan

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op7_secret_scan(spark, sf).collect()
    texts = [docs[r.doc_id][r.start:r.start + r.length] for r in found if r.is_secret]
    planted = sum(t.count('token = "') for t in docs.values())
    assert sum(docs[r.doc_id][r.start - 9:r.start] == 'token = "' for r in found if r.is_secret) == planted
    assert all(len(t) >= 8 for t in texts)
