"""Dedupe, numbering, ranking and selection per group (survey D1, D2, D5, W1-W6,
L1, L2, A5).

All of these are window or aggregate plans.  Filters of the form
``row_number() <= k`` let Catalyst insert a WindowGroupLimit, whose partial
step runs before the shuffle, so even a group holding a third of all rows
sends at most k rows per map task across the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.functions.util import col_of
from cribra.session import write_shared


def _cols(xs) -> list[Column]:
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [col_of(x) for x in xs]


def dedupe_first(df: DataFrame, group, key, order, keep_blank: bool = False,
                 together: bool = False) -> DataFrame:
    """Keep the first row (by ``order``) of every ``(group, key)``.  A long text
    as key is better given as its digest (the empty text as it is).

    ``order`` must be a total order within a group.  With ``keep_blank`` rows
    whose key is empty are never duplicates of each other (D2): they get a key
    of their own built from the order columns, so the plan stays a single
    ``row_number() = 1`` window.

    ``together``: rows are dealt by ``group`` alone, as the steps that follow need them,
    and sorted by ``(key, order)`` in it; where they lie so already nothing is exchanged.
    A group must then fit in a task.
    """
    k = col_of(key)
    if keep_blank:
        own = F.to_json(F.struct(*_cols(order)))
        k = F.struct((k == "").alias("blank"), F.when(k == "", own).otherwise(k).alias("k"))
    if together:
        w = Window.partitionBy(*_cols(group)).orderBy(k, *_cols(order))
        first = (F.row_number().over(w) == 1) | ~F.lag(k).over(w).eqNullSafe(k)
        return df.withColumn("_dd", first).filter("_dd").drop("_dd")
    w = Window.partitionBy(*_cols(group), k).orderBy(*_cols(order))
    return (df.withColumn("_dd", F.row_number().over(w))
              .filter(F.col("_dd") == 1).drop("_dd"))


def number_rows(df: DataFrame, group, order, name: str = "rank", start: int = 0,
                limit: int | None = None) -> DataFrame:
    """W1 (+W2): number rows ``start..`` per group in ``order``; with ``limit``
    keep only the first ``limit`` rows of each group."""
    w = Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
    out = df.withColumn("_rn", F.row_number().over(w))
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be positive")
        out = out.filter(F.col("_rn") <= limit)
    return out.withColumn(name, F.col("_rn") - F.lit(1 - start)).drop("_rn")


def number_large(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank",
                 start: int = 0) -> DataFrame:
    """W1 without a cap for groups of any size: numbers ``start..`` per group in ``order``.

    Rows are dealt to sorted ranges of (group, order) and written to the shared folder, so
    no task holds a group; the row counts of the (range, group) pairs, the only rows that
    meet in a window, give each range its offset.  ``order`` must be total in a group;
    a null group is a group.
    """
    keys = [*group, *order]
    laid = write_shared(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                          .withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(part.alias("_range"), *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", *[F.col(g).alias(f"_g_{g}") for g in group], "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = part == F.col("_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return laid.join(counts, same).select(
        *df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + start).alias(name))


def rank_candidates(df: DataFrame, group, keys: Sequence[Column], name: str = "order_no",
                    limit: int | None = None) -> DataFrame:
    """1-based position of each row in its group under a composite
    sort key (the last key should be a unique tie-break such as the response
    rank, which reproduces a stable sort)."""
    w = Window.partitionBy(*_cols(group)).orderBy(*keys)
    out = df.withColumn(name, F.row_number().over(w))
    if limit is not None:
        out = out.filter(F.col(name) <= limit)
    return out


def best_per_group(df: DataFrame, group, keys: Sequence[Column],
                   name: str = "order_no") -> DataFrame:
    """The first row of every group under ``keys``."""
    return rank_candidates(df, group, keys, name, limit=1)


def first_n(df: DataFrame, n: int | None, ordinal: str = "row_id") -> DataFrame:
    """L1: the first ``n`` input rows by ordinal (not a bare, unordered limit)."""
    if n is None:
        return df
    if n <= 0:
        raise ValueError("first_n must be positive")
    return df.filter(F.col(ordinal) < n)


def collect_ranked(df: DataFrame, group, order_col: str, payload: Sequence[str],
                   name: str = "all") -> DataFrame:
    """A5: every candidate of a group as one list in ``order_col`` order.

    Call it after a per-group cap (W2): the list size is then bounded by the cap
    regardless of skew.
    """
    item = F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in payload])
    return (df.groupBy(*_cols(group))
              .agg(F.array_sort(F.collect_list(item)).alias("_l"))
              .withColumn(name, F.transform("_l", lambda x: x.dropFields("_o")))
              .drop("_l"))
