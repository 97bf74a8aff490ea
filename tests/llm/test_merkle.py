import hashlib
import zlib

import pytest

from cribra.llm import merkle as mk
from oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, key int, rank string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_query_equals_sql(spark, sf):
    res = compare(spark, "op13_merkle_manifest", sf)
    assert res["ok"], res


@pytest.mark.parametrize("n,top", [(1, 0), (2, 1), (16, 1), (17, 2), (257, 3), (300, 3), (4096, 3), (5, 3)])
def test_addresses_are_the_places_in_the_log(n, top):
    nodes = [f"{i}." for i in range(n)]
    log = mk.append_log(nodes, top)
    level, at = nodes, 0
    for k in range(top + 1):
        for i, node in enumerate(level):
            assert log[mk.address(k, i, n, top)] == node
        level = [H(*level[i:i + mk.FAN]) for i in range(0, len(level), mk.FAN)]
        at += 1
    assert len(log) == len(set(mk.address(k, i, n, top) for k in range(top + 1) for i in range(-(-n // 16 ** k))))
    if n == 4096:
        assert len(log) == mk.SEGMENT


def _leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def _climb(nodes, i):
    """Siblings of node i and the root, the plain way."""
    path = []
    while len(nodes) > 1:
        first = i // 16 * 16
        run = nodes[first:first + 16]
        path.append(("".join(run[:i - first]), "".join(run[i - first + 1:])))
        nodes, i = [H(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)], i // 16
    return path, nodes[0]


def _brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = []
    for s in order:
        trees[s].sort(key=lambda e: e[:3])
        tops.append(_climb([e[2] for e in trees[s]], 0)[1])
    out = []
    for k, s in enumerate(order):
        upper, root = _climb(tops, k)
        nodes = [e[2] for e in trees[s]]
        for i, (_, _, leaf, r) in enumerate(trees[s]):
            path = _climb(nodes, i)[0] + upper
            other = leaf
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                other = _leaf(r, r[1].translate(lower))
            for x, y in path:
                other = H(x, other, y)
            out.append((r[0], leaf, tops[k], root, H(*[x + y for x, y in path]), other, other == root))
    return sorted(out, key=str)


def test_several_tiers_odd_rows_and_ties_against_brute_force(make, monkeypatch):
    monkeypatch.setattr(mk, "HEIGHT", 1)  # builders of 16 inputs: several tiers
    monkeypatch.setattr(mk, "BLOCK", 16)
    rows = [(i, f"Text {i} É", "en", "hot" if i % 3 else f"s{i % 60}", i, "r", 1, "x") for i in range(900)]
    rows += [(None, "A", None, None, None, "r", 1, "x"), (None, None, None, None, None, "r", 1, "x"),
             (7, "Other", "en", "hot", 3, "r", 1, "x"), (-5, "", "de", "", 0, "r", 1, "x"),
             (2000, "Lone Ä", "en", "ü", 1, "r", 1, "x"), (2001, "Ab " * 100_000, "en", "hot", 9, "r", 1, "x")]
    rows += [rows[1]] * 40  # repeated rows
    got = sorted(map(tuple, mk.manifest(make(rows, SCHEMA)).collect()), key=str)
    assert got == _brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_empty_table_and_single_row(make):
    assert mk.manifest(make([], SCHEMA)).count() == 0
    row = (1, "a", "en", "s", 1, "r", 1, "x")
    (got,) = mk.manifest(make([row], SCHEMA)).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == H() and got.verified
