import math
import random
from collections import Counter

import numpy as np
import pytest

from cribra.llm import lm_score as lm

SCHEMA = "doc_id long, text string, chunk int, target string, hit boolean"


def brute(rows, target, order=lm.ORDER, prior=lm.PRIOR):
    """doc position -> (n, target loss, background loss)."""
    texts = [(t or "").encode().split() for _, t in rows]
    padded = [[b"<s> "] * order + t for t in texts]  # no word holds a blank
    count = {"t": [Counter() for _ in range(order + 1)], "b": [Counter() for _ in range(order + 1)]}
    ctx = {"t": [Counter() for _ in range(order + 1)], "b": [Counter() for _ in range(order + 1)]}
    for (i, _), p in zip(rows, padded):
        for m in ("tb" if i in target else "b"):
            for e in range(order + 1, len(p) + 1):
                for k in range(1, order + 1):
                    count[m][k][tuple(p[e - k:e])] += 1
                    ctx[m][k][tuple(p[e - k:e - 1])] += 1
    nt, nb = (sum(count[m][1].values()) for m in "tb")
    scale = {"t": 1.0, "b": nt / nb if nb else 0}
    vocabulary = len(count["b"][1])

    def prob(m, g):
        q = 1 / vocabulary
        for k in range(1, order + 1):
            s = tuple(g[-k:])
            q = (count[m][k][s] * scale[m] + prior * q) / (ctx[m][k][s[:-1]] * scale[m] + prior)
        return q
    out = []
    for p in padded:
        n = len(p) - order
        loss = [sum(-math.log(prob(m, p[e - order:e])) for e in range(order + 1, len(p) + 1)) for m in "tb"]
        out.append((n, loss[0] / n, loss[1] / n) if n else (0, None, None))
    return out


def _same(rows, target, got):
    want = Counter()
    for (i, _), (n, t, b) in zip(rows, brute(rows, target)):
        want[(i, n, *(None if x is None else round(x, 4) for x in (t, b, t - b if n else None)))] += 1
    seen = Counter((r.doc_id, r.n_tokens, *(None if x is None else round(x, 4) for x in (
        r.target_loss, r.background_loss, r.score))) for r in got)
    close = lambda a, b: a[:2] == b[:2] and all(
        (x is None) == (y is None) and (x is None or abs(x - y) < 3e-4) for x, y in zip(a[2:], b[2:]))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    a, b = sorted(want.elements(), key=key), sorted(seen.elements(), key=key)
    assert len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))


def test_against_brute_force(make, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_CHARS", 700)
    monkeypatch.setattr(lm, "BUCKET_CHARS", 300)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abé 😀\n") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "ab ab"), (None, None), (5, rows[5][1]), (102, "long " * 900)]
    target = {i for i in range(0, 60, 3)} | {5, 100}
    df = make([(*r, 1, "x", None) for r in rows], SCHEMA)
    ids = make([(i,) for i in target] * 2, "doc_id long")
    _same(rows, target, lm.score(df, ids).collect())
    assert lm.score(df.limit(0), ids).count() == 0
    _same(rows, set(), lm.score(df, ids.limit(0)).collect())


def test_query(spark, sf):
    from cribra.llm.queries import op10_lm_score

    rows = op10_lm_score(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    some = list(docs.items())
    _same(some, good, rows)
    mean = lambda ids: sum(r.score for r in rows if r.doc_id in ids) / len(ids)
    assert mean(good) < mean(set(docs) - good)


def test_shuffled_words_score_worse(make):
    """Same spelling, other word order: only a context longer than a word can tell."""
    rng = random.Random(3)
    words = ["oooo" + "".join(rng.choice("abcdefgh") for _ in range(3)) + "oooo" for _ in range(12)]
    after = {w: rng.sample(words, 2) for w in words}

    def ordered():
        out = [rng.choice(words)]
        while len(out) < 150:
            out.append(rng.choice(after[out[-1]]))
        return out
    rows, texts = [], [ordered() for _ in range(80)]
    for i, t in enumerate(texts):
        rows.append((i, " ".join(t), 0, "", None))
        rows.append((1000 + i, " ".join(rng.sample(t, len(t))), 0, "", None))
    got = {r.doc_id: r.score for r in lm.score(make(rows, SCHEMA), make([(i,) for i in range(40)], "doc_id long")).collect()}
    # documents 40.. are like the target but were not in it
    assert max(got[i] for i in range(40, 80)) < min(got[1000 + i] for i in range(80)) - 0.1


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_other_orders(make, order):
    rng = random.Random(order)
    rows = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 60)))) for i in range(20)]
    got = {r.doc_id: r for r in lm.score(make([(*r, 1, "x", None) for r in rows], SCHEMA),
                                         make([(i,) for i in range(5)], "doc_id long"), order).collect()}
    for (i, _), (n, t, b) in zip(rows, brute(rows, set(range(5)), order)):
        assert got[i].n_tokens == n and (not n or (got[i].target_loss, got[i].background_loss)
                                         == pytest.approx((t, b), abs=3e-4))


def test_a_hot_context(make, monkeypatch):
    """One word before every other word, in all chunks: one entry of each chunk."""
    monkeypatch.setattr(lm, "CHUNK_CHARS", 2000)
    monkeypatch.setattr(lm, "BUCKET_CHARS", 600)
    rng = random.Random(4)
    rows = [(i, " ".join(f"the w{rng.randint(0, 300)}" for _ in range(30))) for i in range(100)]
    df = make([(*r, 1, "x", None) for r in rows], SCHEMA)
    _same(rows, set(range(0, 100, 3)), lm.score(df, make([(i,) for i in range(0, 100, 3)], "doc_id long")).collect())


def test_packed_counts_and_keys():
    rng = np.random.default_rng(0)
    for x in ([], [0, 1, 254, 255, 256, 10 ** 12], rng.integers(0, 400, 5000)):
        x = np.array(x, np.int64)
        assert (lm._unpacked(lm._packed(x)) == x).all() and len(lm._unpacked(lm._packed(x))) == len(x)
    for keys in ([5], [0, 1, 2 ** 64 - 1], np.unique(rng.integers(0, 2 ** 63, 3000))):
        keys = np.array(keys, np.uint64)
        assert (lm._unpacked_keys(lm._packed_keys(keys)) == keys).all()
