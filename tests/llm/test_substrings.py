import random

import numpy as np
import pytest

from cribra.llm import substrings as sub
from oracle import compare

SCHEMA = "doc_id long, text string, row int, h string, starts int, at string"


def test_query_equals_sql(spark, sf):
    res = compare(spark, "op12_substring_dedup", sf)
    assert res["ok"], res


@pytest.mark.parametrize("period", sorted(sub.COVERS))
def test_covers_hold_a_shift_for_every_two_places(period):
    cover = set(sub.COVERS[period])
    for i in range(period):
        assert any(d in cover and (i + d) % period in cover for d in range(period)), (period, i)


def test_word_hashes_do_not_depend_on_place_or_spaces():
    a, at = sub.word_hashes([b"one two", b"", b"  two\n\tone\x0b", "é one".encode(), b"onetwo"])
    assert np.diff(at).tolist() == [2, 0, 2, 2, 1]
    assert a[0] == a[3] == a[5] and a[1] == a[2] and len(set(a.tolist())) == 4
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 12))).encode() for _ in range(5000)]
    h, _ = sub.word_hashes(words)
    assert len(set(h.tolist())) == len(set(words)) == len({(w, x) for w, x in zip(words, h.tolist())})


def _brute(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (doc, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x.decode() for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 5, 35])
def test_against_brute_force(make, window, monkeypatch):
    monkeypatch.setattr(sub, "CHUNK", 3000)  # texts are split into many pieces
    rng = random.Random(window)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400 if window > 1 else 40_000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [fresh(n) for n in (window, window + 1, window + 20, 2 * window + 3, max(1, window - 1))]
    rows = []
    for i in range(120):
        text = fresh(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "  ", "\n", " \x0b"]).join(text), 1, "h", 2, "at"))
    copy = " ".join(fresh(80))
    rows += [(500 + i, copy, 1, "h", 2, "at") for i in range(50)]  # a group of copies
    rows += [(600, "x " * 200, 1, "h", 2, "at"), (601, None, 1, "h", 2, "at"), (602, "", 1, "h", 2, "at"),
             (603, " \n", 1, "h", 2, "at"), (None, copy + " tail", 1, "h", 2, "at"), (7, rows[7][1], 1, "h", 2, "at"),
             (604, " ".join(fresh(30_000)), 1, "h", 2, "at"), (605, "a b " * 3, 1, "h", 2, "at")]
    got = sub.remove_repeats(make(rows, SCHEMA), window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == _brute(rows, window)


def test_empty_table(make):
    assert sub.remove_repeats(make([], SCHEMA)).count() == 0
