import random
import re

import numpy as np

from cribra.llm import near_dups as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rep long, sig string, digest int"


def _set(text, width):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else (
        {tuple(w)} if w else set())


def brute(rows, width, percent):
    """component and set size of each doc_id, by all pairs that share a shingle."""
    sets = {i: _set(t, width) for i, t in rows}
    where, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in where.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            where[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def _got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_against_brute_force(spark, sf):
    from cribra.llm.queries import op6_near_dups

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(op6_near_dups(spark, sf)) == brute(rows, 4, 80)


def test_index_brings_all_close_signatures_together():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, nd.SLOTS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        k = rng.choice(nd.SLOTS, nd.distance(), replace=False)
        row[k] ^= rng.integers(1, 1 << 16, len(k)).astype(np.uint16)
    assert ((a != b).sum(axis=1) == nd.distance()).all()
    assert (nd.index_keys(a) == nd.index_keys(b)).any(axis=1).all()


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 5000, 9000, 3)]
    want = [[len(np.intersect1d(x, y)) for y in sets[1:]] for x in sets]
    assert (nd.overlaps(sets, sets[1:]) == want).all()
    assert nd.overlaps([sets[0]], [sets[0] + np.uint64(99999)]).sum() == 0


def _family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_families_blocks_and_odd_rows(make, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 16)
    rng = random.Random(1)
    texts = []
    for size, most in ((120, 9), (60, 5), (40, 14)):
        base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
        texts += _family(rng, base, size, most)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 90)))
              for _ in range(80)]
    texts += ["same text of copies here"] * 70 + ["Same TEXT of copies here", "two words", "two  words", "a"]
    texts += [None, "", " \n\t", None, " ".join(["r"] * 20000)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = make([(*r, 0, "s", 1) for r in rows], SCHEMA).repartition(6)
    want = brute(rows, 4, 80)
    assert _got(nd.near_duplicates(df, 4, 80)) == want
    kept = nd.drop_near_duplicates(df, 4, 80)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, _, k) in want.items() if k)


def test_a_family_that_is_alike_but_mostly_not_linked(make, monkeypatch):
    """Members meet in buckets of many cells; rows sent on grow with the members."""
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 64)
    sent = []
    across = nd._across_cells
    monkeypatch.setattr(nd, "_across_cells", lambda m, c: sent.append(
        (m.count(), across(m, c).count())) or across(m, c))
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 500)}" for _ in range(40)]
    for n in (200, 800):
        rows = list(enumerate(_family(rng, base, n, 3)))
        df = make([(*r, 0, "s", 1) for r in rows], SCHEMA).repartition(6)
        assert _got(nd.near_duplicates(df, 4, 80)) == brute(rows, 4, 80)
    assert sent[1][1] <= 30 * 800


def test_empty_table_null_ids_repeated_rows(make):
    assert nd.near_duplicates(make([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f", 0, "", 0), (7, "a b c d e f", 0, "", 0), (7, "a b c d e f", 0, "", 0),
            (9, "a b c d e f", 0, "", 0), (9, "other text", 0, "", 0)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept)
                 for r in nd.near_duplicates(make(rows, SCHEMA)).collect())
    assert got == [(0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False), (9, 9, True)]


def test_documents_of_several_texts(make):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(7, a, 0, "", 0), (7, a, 0, "", 0), (9, a, 0, "", 0), (9, "a text that only nine has", 0, "", 0),
            (9, b, 0, "", 0), (9, a + " x", 0, "", 0), (11, b + " y", 0, "", 0), (12, None, 0, "", 0), (None, a, 0, "", 0)]
    kept = [(r.doc_id, r[1]) for r in nd.drop_near_duplicates(make(rows, SCHEMA)).collect()]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(kept, key=key) == sorted([
        (7, a), (9, "a text that only nine has"), (9, b), (12, None), (None, a)], key=key)


def test_query_equals_sql(spark, sf):
    from oracle import compare

    res = compare(spark, "op6_near_dups", sf)
    assert res["ok"], res
