"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import persist_shared


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component is the
    smallest node that is reachable.

    Alternates two star steps until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows.  Both steps
    are a partial aggregation and an equi-join, so a node with many neighbours
    sends one minimum per task and its join partition can be split.  The edge
    table is written to the shared folder after each round; nothing but its row
    count and checksum reaches the driver.  Loops and repeated edges do no harm,
    rows with a null end are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"),
                     (F.col("u").isNotNull() & F.col("v").isNotNull()).alias("ok"))
    e = persist_shared(e.filter("ok AND u <> v").select("u", "v").distinct(), "edges")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")) \
                  .select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                           F.col("m").alias("v"))
        large = persist_shared(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v")).filter("u <> v")
        e = persist_shared(small.distinct(), "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    # each remaining edge joins a node to its component's smallest node
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))
                         .distinct())


def spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what earlier ones did not: at most one fewer than ids."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(left.tolist(), right.tolist()):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    return out
