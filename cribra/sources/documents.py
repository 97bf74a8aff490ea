"""One big JSON object in many tasks (survey S2).

The reader cuts the text after each ``}``.  Where a piece stands (inside a string or not,
how many brackets are open) depends on all pieces before it, but each piece only turns
the string state an even or odd number of times and changes the depth by what it holds
outside strings.  Both follow in two levels: windows inside a split, one row per split
across them.  An element of a list at depth three ends where a piece leaves that depth,
so the pieces between two ends are one element and the structure in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribra.session import scan_splits, write_shared

_SPLIT = ["file", "split"]
_STRING = r'"(?:[^"\\]|\\.)*+"'
#: The structure in front of the first element of a list, up to its brace.
_OPENING = rf'^(?:[^"\[]|{_STRING}|\[(?!\s*\{{))*+\[\s*(?=\{{)'
_NAME = rf'{_STRING}\s*:\s*[\[{{]'
#: Depth of the elements of a list: level, key, list.
_LIST = 3
#: What may stand between elements, by the depth before it, without blanks and with S for
#: each string: in front of the first element of a list, and where no element follows.
_EMPTY = r"S:\[\]"
_FIRST = {0: rf"^\{{S:\{{(?:{_EMPTY},)*+S:\[$", 1: rf"^,S:\{{(?:{_EMPTY},)*+S:\[$", 3: rf"^\](?:,{_EMPTY})*+,S:\[$"}
_LEVEL_END = {0: rf"^\{{S:\{{(?:{_EMPTY}(?:,{_EMPTY})*+)?$", 1: rf"^,S:\{{(?:{_EMPTY}(?:,{_EMPTY})*+)?$",
              3: rf"^\](?:,{_EMPTY})*+$"}
_FILE_END = {0: r"^\{$", 1: "^$"}


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _outside(text: Column, inside: bool) -> Column:
    """What stands outside strings, from either state; escapes are gone already."""
    text = F.regexp_replace(text, '^[^"]*"?', "") if inside else text
    return F.regexp_replace(text, '"[^"]*(?:"|$)', "")


def _rows_before(window) -> object:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _so_far(c: Column | str, window) -> Column:
    return F.coalesce(F.sum(c).over(_rows_before(window)), F.lit(0))


def _few_tasks(pieces: DataFrame) -> DataFrame:
    """Small splits stay apart, but a task reads many of them one after the other: tasks, and
    files of the table, then follow the bytes and the cores, not the splits."""
    splits = pieces.rdd.getNumPartitions()
    cores = pieces.sparkSession.sparkContext.defaultParallelism
    return pieces.coalesce(max(4 * cores, splits // 256)) if splits > 4 * cores else pieces


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, at, piece, size, turns, out, in_``: pieces with what they change,
    written once; ``size`` is the file's."""
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"))
    pieces = _few_tasks(pieces)
    plain = pieces.select("*", F.regexp_replace("piece", r"\\.", "").alias("_p"))
    out, in_ = _outside(F.col("_p"), False), _outside(F.col("_p"), True)
    deeper = lambda x: (_count(x, "[{") - _count(x, "]}")).cast("long")
    return write_shared(plain.select(
        *_SPLIT, "at", "piece", "size", (_count(F.col("_p"), '"') % 2 == 1).alias("turns"),
        deeper(out).alias("out"), deeper(in_).alias("in_")), "pieces")


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds ``after`` (depth after the piece and its brace) and ``inside`` (its brace is
    part of a string)."""
    here, files = Window.partitionBy(*_SPLIT).orderBy("at"), Window.partitionBy("file").orderBy("split")
    turns = F.col("turns").cast("long")
    state = pieces.select("*", _so_far(turns, here).alias("_before"))
    splits = state.groupBy(*_SPLIT).agg(F.sum(turns).alias("_t"))
    splits = splits.select(*_SPLIT, _so_far("_t", files).alias("_first"))
    started = (F.col("_first") + F.col("_before")) % 2 == 1
    state = state.join(splits, _SPLIT).select(
        *_SPLIT, "at", "piece", "size", (started != F.col("turns")).alias("inside"),
        F.when(started, F.col("in_")).otherwise(F.col("out")).alias("_d"))
    # the brace that ended the piece closes one more, but where it is text
    state = state.withColumn("_d", F.col("_d") - F.when(F.col("inside"), 0).otherwise(1))
    state = state.withColumn("_depth", F.sum("_d").over(here))
    splits = state.groupBy(*_SPLIT).agg(F.sum("_d").alias("_all"))
    splits = splits.select(*_SPLIT, _so_far("_all", files).alias("_deep"))
    return state.join(splits, _SPLIT).select(*_SPLIT, "at", "piece", "size", "inside", F.col("_d").alias("change"),
                                             (F.col("_deep") + F.col("_depth")).alias("after"))


def _last_known(df: DataFrame, value: str) -> DataFrame:
    """Fills null ``value`` from the nearest earlier unit of the file that has one."""
    here = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_own", F.last(value, ignorenulls=True).over(here))
    splits = df.groupBy(*_SPLIT).agg(F.max_by("_own", "at").alias("_end"))
    before = _rows_before(Window.partitionBy("file").orderBy("split"))
    splits = splits.select(*_SPLIT, F.last("_end", ignorenulls=True).over(before).alias("_came"))
    return df.join(splits, _SPLIT).withColumn(value, F.coalesce("_own", "_came")).drop("_own", "_came")


def _unquoted(name: Column) -> Column:
    """The text of a JSON string that a name starts with."""
    text = F.regexp_extract(name, rf"^({_STRING})", 1)
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]


def json_lists(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """``file, level, key, pos, row_json``: the elements of an object ``level -> key ->
    [objects]`` per file.  Other shapes fail the read."""
    with scan_splits(spark, split_bytes):  # of the text; the tables made of it have their own
        pieces = piece_table(spark, path)
    placed = write_shared(_placed(pieces), "placed")
    here, files = Window.partitionBy(*_SPLIT).orderBy("at"), Window.partitionBy("file").orderBy("split")

    # a unit ends where a brace leads back to depth three or less
    ends = placed.withColumn("_end", ~F.col("inside") & (F.col("after") <= _LIST))
    ends = ends.withColumn("_unit", _so_far(F.col("_end").cast("long"), here))
    counts = ends.groupBy(*_SPLIT).agg(F.sum(F.col("_end").cast("long")).alias("n"))
    counts = counts.select(*_SPLIT, _so_far("n", files).alias("_units"))
    ends = ends.join(counts, _SPLIT).withColumn("unit", F.col("_units") + F.col("_unit"))
    units = ends.groupBy("file", "unit").agg(
        F.max(F.struct("split", "at", "after", "_end")).alias("last"), F.sum("change").alias("change"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "piece"))),
                                 lambda x: x["piece"]), "}").alias("text"))
    units = units.select("file", "unit", "last.split", "last.at", "last.after", F.col("last._end").alias("closed"),
                         (F.col("last.after") - F.col("change")).alias("before"), "text")

    opening = F.regexp_extract("text", _OPENING, 0)
    row = units.withColumn("_open", opening).withColumn("_names", F.regexp_extract_all("_open", F.lit(_NAME), 0))
    named = lambda mark: F.try_element_at(F.filter("_names", lambda n: n.endswith(mark)), F.lit(-1))
    row = row.withColumn("list", F.when(F.col("_open") != "", F.struct(
        _unquoted(named("[")).alias("key"), F.col("unit").alias("first")))) \
        .withColumn("level", _unquoted(named("{")))
    row = _last_known(_last_known(row, "list"), "level")
    # a file that does not end with a brace is a byte longer by its pieces (a byte order
    # mark, which the reader drops, takes three)
    files = placed.groupBy("file").agg((F.sum(F.octet_length("piece") + 1) - F.max("size")).alias("_over"))
    files = row.groupBy("file").agg(F.max("unit").alias("_final")).join(files, "file")
    row = row.join(files.select("file", "_final", F.col("_over").isin(1, -2).alias("_rest")), "file")
    element = F.col("closed") & (F.col("after") == _LIST)
    structure = F.when(F.col("_open") != "", F.col("_open")).otherwise(F.col("text"))
    bare = F.regexp_replace(F.regexp_replace(structure, _STRING, "S"), r"[\s\x{feff}]+", "")
    fits = lambda forms: F.coalesce(*[F.when(F.col("before") == d, F.col("_bare").rlike(f))
                                      for d, f in forms.items()], F.lit(False))
    row = row.withColumn("_bare", F.when(element & (F.col("_open") == ""), "").otherwise(bare))
    fine = F.when(element & (F.col("_open") != ""), fits(_FIRST)) \
        .when(element, (F.col("before") == _LIST) & F.col("text").rlike(r"^\s*,\s*\{")) \
        .when(F.col("closed") & (F.col("after") == 1), fits(_LEVEL_END)) \
        .otherwise((F.col("after") == 0) & fits(_FILE_END))
    # the object ends with the file, or blanks follow it
    last = F.col("unit") == F.col("_final")
    fine = F.when(last & F.col("_rest"), (F.col("before") == 0) & (F.col("_bare") == "")) \
        .otherwise(fine & ((F.col("after") == 0) == (F.col("unit") == F.col("_final") - F.col("_rest").cast("int"))))
    body = F.when(F.col("_open") != "", F.call_function("substr", F.col("text"), F.length("_open") + 1)) \
        .otherwise(F.regexp_replace("text", r"^\s*,\s*", ""))
    wrong = F.raise_error(F.lit("prototype index must be a JSON object"))
    checked = lambda c: F.when(fine, F.col(c)).otherwise(wrong)
    return row.filter(element | ~fine).select(
        "file", checked("level").alias("level"), checked("list.key").alias("key"),
        (F.col("unit") - F.col("list.first")).alias("pos"), F.concat(body, F.lit("}")).alias("row_json"))


def in_document_order(rows: DataFrame, document: list[str]) -> DataFrame:
    """``pos`` counted on over the documents that hold a (level, key): lists of one key
    follow each other in the order of ``document``."""
    per = rows.groupBy("level", "key", *document).agg((F.max("pos") + 1).alias("_n"))
    before = _rows_before(Window.partitionBy("level", "key").orderBy(*document))  # one row per document
    per = per.select("level", "key", *document, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(per, ["level", "key", *document]).withColumn("pos", F.col("pos") + F.col("_before")) \
               .drop("_before", *document)
