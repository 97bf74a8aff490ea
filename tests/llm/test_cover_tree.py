import numpy as np
import pytest

from cribra.llm import cover_tree as ct
from oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, links long, digest string, n int"


def _unit(n, dim, rng, spread=0.05, centres=8):
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_query_equals_sql(spark, sf):
    res = compare(spark, "op9_embedding_near_dups", sf)
    assert res["ok"], res


@pytest.mark.parametrize("dim,spread", [(3, 0.3), (64, 0.03), (64, 5.0)])
def test_tree_is_nested_covering_and_the_walk_is_exact(dim, spread):
    rng = np.random.default_rng(dim)
    x, y = _unit(300, dim, rng, spread), _unit(170, dim, rng, spread)
    reach = 0.2
    t, u = ct.CoverTree(x, reach / 2), ct.CoverTree(y, reach / 2)
    for (ca, _, ra), (cb, pb, rb) in zip(t.levels, t.levels[1:]):
        assert set(ca) <= set(cb)
        gap = np.linalg.norm(x[ca[pb]] - x[cb], axis=1)
        assert (gap <= ra[pb] + 1e-7).all()
    assert sorted(t.levels[-1][0]) == list(range(300))
    got = set(zip(*(z.tolist() for z in ct.dual_pairs(t, u, reach))))
    d = np.linalg.norm(x[:, None] - y[None], axis=2)
    assert set(zip(*(z.tolist() for z in np.nonzero(d <= reach - 1e-7)))) <= got
    assert len(got) == (d <= reach + 1e-6).sum()


def _brute(rows, cosine):
    ok = {i: (v, l) for i, v, l in rows if l is not None and v and None not in v
          and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, _, _ in rows}
    for a, (x, l) in ok.items():
        for b, (y, m) in ok.items():
            x64, y64 = np.float64(np.float32(x)), np.float64(np.float32(y))
            if a < b and l == m and len(x) == len(y) and \
                    x64 @ y64 / np.sqrt((x64 @ x64) * (y64 @ y64)) >= cosine:
                links[a].add(b), links[b].add(a)
    comp = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += links[j]
    return {i: (len(n), comp[i], comp[i] == i) for i, n in links.items()}


def test_blocks_cells_and_bad_rows_against_brute_force(make, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 40)  # many cells, split cells and block pairs
    rng = np.random.default_rng(1)
    x = _unit(400, 6, rng, 0.06)
    rows = [(i, [float(f) for f in v], int(i % 3 == 0)) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)]  # a large group of copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 6, 1), (2003, [1.0, None] * 3, 1),
             (2004, [float("nan")] * 6, 1), (2005, [float("inf")] * 6, 1), (2006, rows[3][1], None),
             (2007, rows[3][1][:5], 1), (2008, [3 * f for f in rows[3][1]], 1)]
    df = make([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in ct.threshold_links(df, 0.98).collect()}
    assert got == _brute(rows, 0.98)


def test_empty_table_null_ids_and_repeated_rows(make):
    assert ct.threshold_links(make([], SCHEMA)).count() == 0
    rows = [(None, [1.0, 0.0], 1, 0, "", 0), (5, [1.0, 0.0], 1, 0, "", 0), (5, [1.0, 0.0], 1, 0, "", 0)]
    got = sorted(map(tuple, ct.threshold_links(make(rows, SCHEMA)).collect()), key=str)
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (None, 0, None, True)]
