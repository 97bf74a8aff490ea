import hashlib
import random
import re

from pyspark.sql import functions as F

from cribra.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _likeness(a, b):
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def _check(rows, result):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    text = [r[1] or "" for r in order]
    want = {}
    for i, r in enumerate(order):
        own, nxt = text[i], text[(i + 1) % len(order)]
        h = len(own) // 2
        want.setdefault(r[0], []).append((own, own[:len(own) - h] + nxt[:h], nxt))
    err, prints, n = 0.0, {}, 0
    for r in result:
        options = [w for w in want[r.doc_id] if hashlib.sha256(w[1].encode()).hexdigest() == r.edited_sha256
                   and len(w[0]) == r.n_chars]
        assert options, r.doc_id
        own, edited, nxt = options[0]
        want[r.doc_id].remove(options[0])
        prints.setdefault(own, set()).add(r.fingerprint)
        assert r.near_edited >= 0 and len(r.fingerprint) == 16 * min(fp.K, len(_shingles(own)))
        e = [abs(r.near_edited - _likeness(own, edited)), abs(r.near_next - _likeness(own, nxt))]
        assert max(e) < 0.2
        err, n = err + sum(e), n + 2
    assert not any(want.values()) and all(len(p) == 1 for p in prints.values())
    assert len({p for s in prints.values() for p in s}) >= len({frozenset(_shingles(t)) for t in prints}) - 1
    assert n == 0 or err / n < 0.03


def test_query_against_brute_force(spark, sf):
    from cribra.llm.queries import op4_fingerprints

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    _check(rows, op4_fingerprints(spark, sf).collect())


def test_ranges_nulls_and_repeated_rows(make, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rng = random.Random(3)
    ids = rng.sample(range(-50, 10**6), 90) + [5, 5, 5, None, None]
    texts = [None, "", "  \n", "one", "A b é 😀", "w" * 3000] + [
        " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 80))) for _ in range(30)]
    rows = [(i, rng.choice(texts), "x", 1) for i in ids]
    df = make(rows, "doc_id long, text string, sketch string, range int").repartition(5)
    _check(rows, fp.fingerprint_edits(df).collect())
    assert fp.fingerprint_edits(df.limit(0)).count() == 0
    one = fp.fingerprint_edits(make([(3, "a b c d", "", 0)], df.schema)).first()
    assert one.near_next == 1.0


def test_parts_merge_and_estimates(make):
    rng = random.Random(8)
    a = [f"x{rng.randint(0, 400)}" for _ in range(3000)]
    whole = " ".join(a)
    parts = [" ".join(a[i:i + 304]) for i in range(0, 3000, 300)]  # overlap by 4 words
    df = make([(1, p) for p in parts] + [(2, None), (3, "q")], "key long, text string")
    merged = {r.key: r.sketch for r in fp.merge(fp.with_sketch(df, "text", "sketch"), "key", "sketch").collect()}
    own = fp.with_sketch(make([(1, whole)], "key long, text string"), "text", "sketch").first().sketch
    assert merged[1] == own and merged[2] == [] and len(merged[3]) == 1
    two = make([(whole, " ".join(a[:1500]), None)], "a string, b string, c string")
    for c in "abc":
        two = fp.with_sketch(two, c, f"s{c}")
    r = two.select(fp.containment(F.col("sb"), F.col("sa")).alias("in"),
                   fp.containment(F.col("sc"), F.col("sa")).alias("none"),
                   fp.distinct_shingles(F.col("sa")).alias("n"), fp.resemblance(F.col("sc"), F.col("sc")).alias("e"),
                   fp.distinct_shingles(F.col("sc")).alias("z")).first()
    assert r["in"] > 0.85 and r["none"] == 1.0 and abs(r.n / len(_shingles(whole)) - 1) < 0.3
    assert (r.e, r.z) == (1.0, 0.0)
