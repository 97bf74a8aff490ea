"""CSV records of files that many tasks read, however the quotes lie (survey S1, L1).

A quoted field may hold line ends, so whether a line starts a record depends on all
lines before it.  But a line only maps one state (outside or inside a quoted field) to
another: it keeps it, turns it, or sets it.  Such maps compose, so the state before each
line follows in two levels: windows inside each split of a file, and one row per split
across them.  The same two levels number the records.  Only the lines of records that
take several are put together by a shuffle.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribra.session import scan_splits, write_shared

#: A quoted field from its start to the delimiter after it, and the rest of one.
_FIELD = r'(?:^|(?<=,))"(?:[^"]|"")*+"[^,]*'
_REST = r'^(?:[^"]|"")*+"[^,]*'
#: How ``from_csv`` reads one record, as the file reader does.
RECORD_OPTIONS = {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "lineSep": "\x00",
                  "maxCharsPerColumn": "-1", "maxColumns": "100000"}


def _after(line: Column) -> Column:
    """Whether a line that starts outside a quoted field ends inside one: complete
    fields go, then a field that still starts with a quote is open."""
    return F.regexp_replace(line, _FIELD, "").rlike('(?:^|,)"')


def with_states(lines: DataFrame) -> DataFrame:
    """Adds ``turn`` (the line turns the state) and ``sets`` (the state it leaves
    whatever came before, else null) to ``lines(line)``."""
    plain = ~F.col("line").contains('"')
    closes = F.col("line").rlike(_REST)
    from_out = _after(F.col("line"))
    from_in = F.when(closes, _after(F.regexp_replace("line", _REST, ""))).otherwise(True)
    out = lines.select("*", F.when(plain, False).otherwise(from_out).alias("_out"),
                       F.when(plain, True).otherwise(from_in).alias("_in"))
    return out.select(*lines.columns, (F.col("_out") & ~F.col("_in")).alias("turn"),
                      F.when(F.col("_out") == F.col("_in"), F.col("_out")).alias("sets"))


def _state(known: Column, turns: Column) -> Column:
    """The state after ``turns`` more turns from ``known``."""
    return known != (turns % 2 == 1)


def line_table(spark: SparkSession, paths: str | Sequence[str], separator: str = "\n") -> DataFrame:
    """``file, split, at, line, turn, sets``: all lines with their place, written once.

    ``split`` is where a task's part of the file starts; ``at`` orders the lines in it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths, lineSep=separator).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("value").endswith("\r").alias("cr"))  # only the end of a record loses it
    return write_shared(with_states(lines), "lines")


def csv_records(lines: DataFrame) -> DataFrame:
    """``file, in_file, record``: the records of a ``line_table`` with their 0-based place
    in the file.  Empty lines outside quoted fields are no records."""
    split = ["file", "split"]
    here = Window.partitionBy(*split).orderBy("at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.col("turn").cast("long")).over(before), F.lit(0))
    marked = lines.select("*", turns.alias("_turns")).select("*", F.last(F.when(
        F.col("sets").isNotNull(), F.struct("sets", F.col("_turns").alias("turns"))),
        ignorenulls=True).over(before).alias("_set"))

    # the state at the start of each split, from one row per split
    ends = marked.groupBy(*split).agg(F.max_by(F.struct(
        "_turns", "turn", "sets", "_set"), "at").alias("e")).select(
        *split, F.when(F.col("e.sets").isNotNull(), F.lit(0).cast("long"))
        .otherwise(F.col("e._turns") + F.col("e.turn").cast("long")
                   - F.coalesce(F.col("e._set.turns"), F.lit(0))).alias("turns"),
        F.coalesce("e.sets", "e._set.sets").alias("sets"))
    up_to = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("*", F.coalesce(F.sum("turns").over(up_to), F.lit(0)).alias("_all")) \
        .select("*", F.last(F.when(F.col("sets").isNotNull(), F.struct(
            "sets", F.col("_all").alias("before"), "turns")), ignorenulls=True).over(up_to).alias("_set"))
    start = _state(F.coalesce(F.col("_set.sets"), F.lit(False)),
                   F.col("_all") - F.coalesce(F.col("_set.before"), F.lit(0)))
    starts = ends.select(*split, start.alias("_start"))
    placed = marked.join(starts, split).select(
        *split, "at", "line", "cr", "turn", "sets",
        _state(F.coalesce(F.col("_set.sets"), F.col("_start")),
               F.col("_turns") - F.coalesce(F.col("_set.turns"), F.lit(0))).alias("inside"))
    placed = placed.select("*", F.coalesce("sets", F.col("inside") != F.col("turn")).alias("open")) \
        .filter("inside OR line <> ''")
    placed = placed.select("*", F.sum((~F.col("inside")).cast("long")).over(here).alias("_nth"))

    # records before each split
    counts = placed.groupBy(*split).agg(F.max("_nth").alias("n"))
    counts = counts.select(*split, F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("_before"))
    placed = placed.join(counts, split).select(
        "file", (F.col("_before") + F.col("_nth") - 1).alias("in_file"), "split", "at", "line", "cr", "inside", "open")
    alone = placed.filter("NOT inside AND NOT open").select("file", "in_file", F.col("line").alias("record"))
    piece = F.concat("line", F.when(F.col("cr") & F.col("open"), F.lit("\r")).otherwise(F.lit("")))
    several = placed.filter("inside OR open").groupBy("file", "in_file").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("split", "at", piece.alias("line")))),
        lambda x: x["line"]), "\n").alias("record"))
    return alone.unionByName(several)


def _header(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record.lstrip("\ufeff"), newline="")), [])


def _separator(spark: SparkSession, paths: list[str]) -> str:
    """Line end of the files: a carriage return where no line feed follows the first."""
    first = spark.read.text(paths[:1], lineSep="\n").first()
    text = first["value"] if first else ""
    return "\r" if "\r" in text[:-1] else "\n"


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path by name; their content is not read."""
    return [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]


def read_csv(spark: SparkSession, path: str, ordinal: str = "row_id", first_n: int | None = None,
             split_bytes: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns as text, by the header that every file starts with, and ``ordinal``:
    contiguous from 0, files by path, records as they stand.

    ``columns`` must all be in the header; without them every column is read but one that
    is named like the ordinal.

    A file may be read by any number of tasks.  With ``first_n`` only as many files are
    read as hold that many records, by their counts.  ``split_bytes`` bounds a task's
    part of a file for this scan.  A file whose header differs fails the read.
    """
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"No rows in {path}")
    separator = _separator(spark, files)
    used, found = len(files) if first_n is None else 1, None
    while found is None:
        with scan_splits(spark, split_bytes):
            lines = line_table(spark, files[:used], separator)
        records = write_shared(csv_records(lines), "records")
        if used >= len(files) or records.filter("in_file > 0").count() >= first_n:
            found = records
        else:
            used = min(2 * used, len(files))
    heads = found.filter("in_file = 0").select("record").distinct().limit(2).collect()
    headers = {tuple(_header(r["record"])) for r in heads}
    if not headers:
        raise ValueError(f"No rows in {path}")
    if len(headers) > 1:
        raise ValueError(f"Headers differ in {path}: {sorted(headers)}")
    names = list(headers.pop())
    missing = [c for c in columns or () if c not in names]
    if missing:
        raise ValueError(f"Missing columns in {path}: {missing}")
    schema = ", ".join(f"`{i}` string" for i in range(len(names)))
    sizes = found.groupBy("file").agg(F.max("in_file").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = found.filter("in_file > 0").join(sizes, "file").select(
        (F.col("_before") + F.col("in_file") - 1).alias(ordinal),
        F.from_csv("record", schema, RECORD_OPTIONS).alias("_r"))
    if first_n is not None:
        rows = rows.filter(F.col(ordinal) < first_n)
    # a column named twice is read where it stands first
    wanted = [c for c in dict.fromkeys(names) if c != ordinal] if columns is None else columns
    return rows.select(*[F.col("_r")[str(names.index(c))].alias(c) for c in wanted], ordinal)
