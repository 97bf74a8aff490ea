import numpy as np
import pytest

from cribra.llm import hard_negatives as hn
from oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, row string, mean int, rank string"


def test_query_equals_sql(spark, sf):
    res = compare(spark, "op11_hard_negatives", sf)
    assert res["ok"], res


@pytest.mark.parametrize("dim", [1, 3, 16, 50, 64])
def test_bounds_hold_and_narrow_level_by_level(dim):
    rng = np.random.default_rng(dim)
    x, y = (np.floor(256 * rng.normal(size=(n, dim))) for n in (40, 60))
    exact, last = x @ y.T, np.inf
    a, b = (hn.coarser(*hn.summaries(v), dim) for v in (x, y))
    for (ma, da), (mb, db) in zip(a, b):
        mid, spread = ma @ mb.T, da @ db.T
        assert (np.abs(exact - mid) <= spread + 1e-6).all()
        assert spread.mean() <= last + 1e-9
        last = spread.mean()
    assert len(a[0][0][0]) == 1 and len(a[-1][0][0]) == min(dim, hn.SEGMENTS)


def _brute(rows):
    use = []
    for i, v, l, *_ in rows:
        if i is None or l is None or not v or None in v or not np.isfinite(v).all():
            continue
        x = np.floor(256 * np.float64(np.float32(v)))
        if x @ x < 2.0 ** 62:
            use.append((i, (l + 1) % 10 if i % 7 == 0 else l, [int(c) for c in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (i, l, x) in enumerate(use):
        if i % 50:
            continue
        others = sorted(((-dot(x, y), j, b) for b, (j, m, y) in enumerate(use)
                         if m == l and b != a and len(y) == len(x)))[:5]
        for s, j, _ in others:
            s = -s
            found = sorted((-dot(x, y), k) for k, m, y in use if m != l and len(y) == len(x)
                           and 50 * s <= 100 * dot(x, y) <= 95 * s)[:3]
            out += [(i, j, n + 1, k, s, -t) for n, (t, k) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("dim", [4, 33])
def test_against_brute_force(make, dim, monkeypatch):
    for name, value in (("ANCHORS", 3), ("ROWS", 60), ("TILE", 25)):  # many blocks and tiles
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    rows = [(i, [float(c) for c in centres[rng.integers(6)] + 0.4 * rng.normal(size=dim)], int(rng.integers(-1, 10)),
             "r", 1, "x") for i in range(700)]
    rows += [(1000 + i, rows[4][1], 3, "r", 1, "x") for i in range(80)]  # copies: ties by vec_id
    rows += [(50, rows[60][1], 2, "r", 1, "x"), (51, None, 1, "r", 1, "x"), (100, [], 1, "r", 1, "x"),
             (150, [None] * dim, 1, "r", 1, "x"), (200, [float("nan")] * dim, 1, "r", 1, "x"),
             (250, [float("inf")] * dim, 1, "r", 1, "x"), (300, rows[3][1], None, "r", 1, "x"),
             (None, rows[3][1], 1, "r", 1, "x"), (350, rows[3][1][:2], 1, "r", 1, "x"),
             (400, [0.0] * dim, 4, "r", 1, "x"), (450, [3e38] * dim, 4, "r", 1, "x"), (-50, rows[9][1], 4, "r", 1, "x")]
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                 for r in hn.hard_negatives(make(rows, SCHEMA)).collect())
    assert got == _brute(rows) and len(got) > 100


def test_empty_table_and_too_few_rows(make):
    assert hn.hard_negatives(make([], SCHEMA)).count() == 0
    one = [(50, [1.0, 2.0], 1, "r", 1, "x")]
    assert hn.hard_negatives(make(one, SCHEMA)).count() == 0
    two = one + [(51, [1.0, 2.0], 1, "r", 1, "x"), (52, [0.5, 1.5], 2, "r", 1, "x")]
    got = hn.hard_negatives(make(two, SCHEMA)).collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in got] == [(50, 51, 52)]


def test_tiles_that_bounds_leave_whole_are_multiplied_whole(monkeypatch):
    """Exact scores, pair by pair only where few are left or doubles would round."""
    import pandas as pd
    rng = np.random.default_rng(3)
    side = lambda x: hn._Side(pd.DataFrame({
        "row": range(len(x)), "vec_id": range(len(x)), "label": 0, "v": [r.tobytes() for r in x],
        **{c: [r.tobytes() for r in m] for c, m in zip(("mean", "dev"), hn.summaries(x.astype(float)))}}), x.shape[1])
    pairs = []
    real = np.einsum
    monkeypatch.setattr(hn.np, "einsum", lambda how, x, y: pairs.append(len(x)) or real(how, x, y))
    for top, few in ((900, False), (900, True), (2 ** 28, False)):
        a, b = (side(rng.integers(-top, top, (n, 64))) for n in (40, 90))
        t = slice(30, 90)
        i, j = (v.ravel() for v in np.indices((40, 60)))
        if few:
            i, j = i[::40], j[::40]
        assert (hn._scores(a, i, b, j, t) == (a.x.astype(object) @ b.x[t].astype(object).T)[i, j]).all()
    assert pairs == [60, 2400]
