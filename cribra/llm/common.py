"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribra.session import shared_path

#: Rank file of the registered queries and weights of the sources there, repeated over
#: their code point order.
RANKS = "byte_bpe_multi_50k.tiktoken"
WEIGHTS = [5, 2, 1]
#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch unless the caller has set it: texts are long, and a batch is
#: held on both sides of each Python worker.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, so that every engine agrees."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Drops the shuffles of a query when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persist_shared(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage without depending on an executor's own disk; the name is
    unique per call, so jobs on one folder never meet.  The shuffles that made the
    table go when it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    small_batches(spark)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path, **options)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank``, the 0-based place of each row in its group, and writes the table.
    For each column of ``sums`` also ``{column}_before``, its sum over the rows before.

    Rows are dealt to sorted ranges, so no group meets in one task; the rows of every
    (range, group) then give its offset.  Only these counts meet in a window.  Rows
    equal in all columns named take any order among themselves.
    """
    keys = [*group, *order, "_turn"]
    laid = persist_shared(
        df.withColumn("_turn", F.monotonically_increasing_id())
          .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_turn")
          .withColumn("_at", F.monotonically_increasing_id())
          .withColumn("_range", F.shiftright("_at", 33)), "sorted")
    counts = laid.groupBy("_range", *group).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_all_{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("_range", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    counts = counts.select("_range", *group, "_first", so_far("_n", before).alias("_before"),
                           *[so_far(f"_all_{c}", before).alias(f"_to_{c}") for c in sums])
    return laid.withColumns({f"_in_{c}": so_far(c, here) for c in sums}).join(counts, ["_range", *group]) \
        .withColumns({"rank": F.col("_before") + F.col("_at") - F.col("_first"),
                      **{f"{c}_before": F.col(f"_to_{c}") + F.col(f"_in_{c}") for c in sums}}) \
        .drop("_range", "_at", "_first", "_before", *[f"{x}{c}" for c in sums for x in ("_in_", "_to_")])
