"""Keyed lookups (survey S2, J1, J4, F7, F9, D5, W6).

The key ladder is a relational plan: each request's (level, key) pairs are
exploded, equi-joined to the index, deduplicated by row value and cut to the
first k per tuple of keys; requests then take the hints of their tuple.  The index is
pre-trimmed to k distinct rows per (level, key) first, which bounds the join fan-out to
3 x k per tuple even on hot keys, and a tuple that a third of all requests hold is
looked up once.  The join strategies (broadcast or sort-merge, skew splitting) are left
to Catalyst's size estimate and AQE's runtime statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.functions.text import join_keys, strip_ws
from cribra.functions.util import col_of
from cribra.operators import select as sl
from cribra.session import write_shared
from cribra.sources import documents

# Open and close tags of the rendered hint block.
HINT_OPEN, HINT_CLOSE = "<PROTOTYPE_HINTS_V4>", "</PROTOTYPE_HINTS_V4>"
LEVELS = ("level1", "level2", "level3")
TOP_K = 3


def _get(m: Column, k: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))


def ladder_keys(fields) -> Column:
    """``ARRAY<STRUCT<level, key>>`` tried in order: the prototype bucket,
    then ratio|sg|zZ|nN|metric|position|stack, then ratio|sg|zZ|nN."""
    m = col_of(fields)
    ratio, sg = _get(m, "reduced_ratio"), _get(m, "condition_sg_number")
    z = F.concat(F.lit("z"), _get(m, "output_Z_raw"))
    n = F.concat(F.lit("n"), _get(m, "n_listed_sites"))
    return F.array(
        F.struct(F.lit(LEVELS[0]).alias("level"), _get(m, "prototype_bucket_v4").alias("key")),
        F.struct(F.lit(LEVELS[1]).alias("level"), join_keys(
            [ratio, sg, z, n, _get(m, "metric_family"), _get(m, "position_family"),
             _get(m, "stack_family")]).alias("key")),
        F.struct(F.lit(LEVELS[2]).alias("level"), join_keys([ratio, sg, z, n]).alias("key")),
    )


def read_index(spark: SparkSession, path: str, layout: str = "object",
               split_bytes: int | None = None) -> DataFrame:
    """Index as JSON ``level -> key -> [row objects]`` -> ``(level, key,
    pos, row VARIANT)``.

    ``layout="object"``: every file is one JSON object, cut into rows by as many tasks
    as it has splits (``split_bytes`` bounds one).  ``layout="lines"``: every line is
    such an object.  ``pos`` is the place in the list; where several documents hold a
    list of one (level, key), they follow each other by file name (and line), so the
    hints are the same in every run.  A value that is not an object fails the job.
    """
    if layout == "object":
        rows = documents.json_lists(spark, path, split_bytes)
        rows = documents.in_document_order(rows, ["file"])
    elif layout == "lines":
        raw = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"), "value").filter(F.trim("value") != "")
        parsed = raw.select("file", "split", "at", "value", F.from_json(
            "value", "map<string,map<string,array<string>>>").alias("idx"))
        parsed = parsed.select("file", "split", "at", F.when(
            F.trim("value").startswith("{") & F.col("idx").isNotNull(), F.col("idx"))
            .otherwise(F.raise_error(F.lit("prototype index must be a JSON object"))).alias("idx"))
        lists = parsed.select("file", "split", "at", F.explode("idx").alias("level", "keys")) \
                      .select("file", "split", "at", "level", F.explode("keys").alias("key", "rows"))
        # written, as the place of a line is only settled once
        rows = write_shared(lists.select("file", "split", "at", "level", "key",
                                         F.posexplode("rows").alias("pos", "row_json")), "index")
        rows = documents.in_document_order(rows, ["file", "split", "at"])
    else:
        raise ValueError("layout must be 'object' or 'lines'")
    return rows.select("level", "key", F.col("pos").cast("long").alias("pos"), F.parse_json("row_json").alias("row"))


def row_text(row: Column, field: str = "scaffold_full") -> Column:
    """Text of a field of an index row (VARIANT or string JSON), stripped."""
    return strip_ws(F.coalesce(F.try_variant_get(row, f"$.{field}", "string"), F.lit("")))


def trim_index(index: DataFrame, value_key: Column | str, k: int = TOP_K,
               level: str = "level", key: str = "key", pos: str = "pos") -> DataFrame:
    """Keep the first k distinct rows (by value) of every (level, key) list.

    Only those can ever be selected by the ladder, so this is exact.
    """
    idx = index.withColumn("_vk", col_of(value_key))
    idx = sl.dedupe_first(idx, [level, key], "_vk", pos)
    return sl.number_rows(idx, [level, key], pos, "_kpos", limit=k).drop("_kpos")


def ladder_join(requests: DataFrame, keys_col: str, index: DataFrame, value_key,
                payload: str, k: int = TOP_K, request_key: str = "row_id") -> DataFrame:
    """J1 + D5 + W6: per request, the first k distinct index rows over the ladder.

    ``requests`` has ``request_key`` and an ``ARRAY<STRUCT<level,key>>`` column;
    ``index`` has ``(level, key, pos, <payload>)``.  Output: ``(request_key,
    hint_no, <payload>)`` with hint_no 0..k-1.  Requests with no match yield no
    rows (see ``hint_block`` for the rendered text with the empty default).
    """
    if k < 1:
        raise ValueError("top_k must be at least 1")
    # hints once per distinct tuple of keys: requests that share one share its hints
    tuples = requests.groupBy(keys_col).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(keys_col).alias("_keys"), tuple_id(keys_col).alias("_tuple"))
    levels = tuples.select("_tuple", F.posexplode("_keys").alias("level_no", "lk")) \
                   .select("_tuple", "level_no", F.col("lk.level").alias("level"), F.col("lk.key").alias("key"))
    trimmed = trim_index(index, value_key, k).select("level", "key", "pos", "_vk", payload)
    hits = levels.join(trimmed, ["level", "key"], "inner")
    hits = sl.dedupe_first(hits, "_tuple", "_vk", ["level_no", "pos"])
    hits = sl.number_rows(hits, "_tuple", ["level_no", "pos"], "hint_no", limit=k)
    return requests.select(request_key, tuple_id(keys_col).alias("_tuple")).join(
        hits.select("_tuple", "hint_no", payload), "_tuple").select(request_key, "hint_no", payload)


def tuple_id(keys) -> Column:
    """256-bit digest of a tuple of (level, key) pairs."""
    return F.unhex(F.sha2(F.to_json(col_of(keys)), 256))


def hint_block(hints: DataFrame, text_col: str, request_key: str = "row_id",
               name: str = "hints") -> DataFrame:
    """open tag, per hint a ``[hint_i]`` line and its stripped text, close
    tag; one row per request that has hints (at most k entries per list)."""
    g = hints.groupBy(request_key).agg(
        F.array_sort(F.collect_list(F.struct("hint_no", strip_ws(text_col).alias("t"))))
         .alias("_h"))
    lines = F.flatten(F.transform("_h", lambda h: F.array(
        F.concat(F.lit("[hint_"), h["hint_no"].cast("string"), F.lit("]")), h["t"])))
    body = F.array_join(F.concat(F.array(F.lit(HINT_OPEN)), lines, F.array(F.lit(HINT_CLOSE))),
                        "\n")
    return g.select(request_key, body.alias(name))


def attach_hints(requests: DataFrame, request_key: str = "row_id", *,
                 hint_text: str | None = None, blocks: DataFrame | None = None,
                 name: str = "hints") -> DataFrame:
    """Constant hint text wins over index hints; neither -> empty text.

    The precedence is decided once, at plan time.  Index hints are joined back
    with a left join so every request keeps its row.
    """
    if hint_text:
        return requests.withColumn(name, F.lit(hint_text.strip()))
    if blocks is None:
        return requests.withColumn(name, F.lit(""))
    return (requests.join(blocks, request_key, "left")
                    .withColumn(name, F.coalesce(F.col(name), F.lit(""))))
