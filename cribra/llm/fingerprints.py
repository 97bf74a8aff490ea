"""Bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit shingle hashes.
Sketches of parts merge into the sketch of the whole, and two sketches estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.llm.common import ascii_lower, words

K, WIDTH = 128, 5
#: Documents per range of doc_id, and ranges at most.
RANGE_ROWS, MAX_RANGES = 512, 16384


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds column ``name``: the sketch of column ``text``.

    Words are lower-cased (A-Z); a text of fewer than ``width`` words is one
    shingle; null, empty and blank texts have an empty sketch.  Each step is a
    column of its own, so that nothing is computed twice.
    """
    w, s = f"{name}__words", f"{name}__shingles"
    df = df.withColumn(w, words(ascii_lower(F.col(text))))
    df = df.withColumn(w, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(w)
    df = df.withColumn(s, F.when(n >= width, F.transform(
        F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])))
        .when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>")))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(s)), 1, k)).drop(w, s)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketches: the share of both among the
    ``k`` smallest of their union.  Two empty sketches are alike (1.0)."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second one has; an
    empty first text is contained in any (1.0)."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)) \
            .otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def merge(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch per ``key`` of many parts' sketches: ``key, sketch``.

    Repeated hashes go before the shuffle and every task keeps a key's ``k``
    smallest only, so a hot key costs ``k`` rows per task.  Null sketches count as
    empty; a key with empty sketches only has an empty one.
    """
    hashes = parts.select(F.col(key).alias("key"), F.explode_outer(sketch).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("h").asc_nulls_last()))
    small = hashes.withColumn("r", rank).filter(F.col("r") <= k)
    return small.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias(sketch)) \
                .withColumnRenamed("key", key)


def as_text(sketch: Column) -> Column:
    """The hashes as 16 hexadecimal digits each, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _ranges(docs: DataFrame) -> list[int]:
    """Ends of ranges of doc_id with about RANGE_ROWS documents each."""
    n = docs.count()
    count = min(MAX_RANGES, n // RANGE_ROWS)
    if count < 1:
        return []
    return docs.agg(F.percentile_approx(
        "doc_id", [i / (count + 1) for i in range(1, count + 1)], 10 * (count + 1))).first()[0] or []


def _range_of(doc_id: Column, ends: list[int]) -> Column:
    """Number of ends below doc_id, by binary search; null ids come lowest."""
    if not ends:
        return F.lit(0)
    # one literal array of at most MAX_RANGES numbers
    table = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<long>")
    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda pos, step: F.when(F.get(table, pos + step - 1) < doc_id, pos + step).otherwise(pos))
    return F.when(doc_id.isNull(), -1).otherwise(found)


def beside_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text, sketch, next_sketch``: each document with the next
    one in descending doc_id (after the last: the first).

    Ranges of doc_id are sorted on their own; a copy of the first document of the
    range below closes each range, so texts are shuffled once.  Null texts count as
    empty; rows without doc_id come last; equal ids are in order of their text.
    """
    at = _range_of(F.col("doc_id"), _ranges(docs)).alias("range")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at)
    # the first document of each range, by id first and text where ids are equal
    top = docs.select("doc_id", at).groupBy("range").agg(F.max("doc_id").alias("doc_id"))
    firsts = d.join(F.broadcast(top.withColumnRenamed("doc_id", "top")), "range") \
              .filter(F.col("doc_id").eqNullSafe(F.col("top"))) \
              .groupBy("range", "doc_id").agg(F.min("text").alias("text"))
    order = Window.orderBy("range")  # one row per range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = top.select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(whole))
                       .alias("above"))
    closing = firsts.join(F.broadcast(above), "range").select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.col("above").alias("range"),
        F.lit(True).alias("copy"))
    both = d.withColumn("copy", F.lit(False)).select("doc_id", "text", "range", "copy") \
            .unionByName(closing).repartition("range")
    both = with_sketch(both, "text", "sketch")
    line = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return both.select("doc_id", "text", "copy", "sketch",
                       F.lead("text").over(line).alias("next_text"),
                       F.lead("sketch").over(line).alias("next_sketch")) \
               .filter("NOT copy").drop("copy")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text's last ``floor(n_chars / 2)`` code points are the first as many
    (or all) of the next document's.  ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``; the last two estimate the likeness
    of the document's shingles to the edited text's and to the next document's.  One
    document alone is its own next; an empty table gives no rows.
    """
    d = beside_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(
        F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substr("next_text", F.lit(1), half)))
    d = d.select("doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"),
                 "sketch", "next_sketch")
    d = with_sketch(d, "edited", "edited_sketch")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
