"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Only vectors of one label are compared.  Equal vectors are one class from the
start.  The classes of a label are dealt into blocks: by the nearest of a few
pivots, and by hash where a pivot's cell is larger than a block, so no label and no
cell ever meets in one task.  Block pairs whose balls are too far apart go before
any vector moves; for the others one task builds a cover tree per block and walks
both trees together.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import persist_shared
from cribra.llm.graph import components, spanning

#: Vectors of a block; bounds the memory of a task.
BLOCK = 2048
#: Pivots at most, and vectors they are chosen from; both fixed, not by table size.
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Rounding allowed for in distance bounds (vectors have length 1).
SLOP = 1e-9


class CoverTree:
    """Nested levels of centres over unit vectors, radii 2, 1, 1/2, ...

    ``levels[l]`` holds ``(centres, parents, radii)``: indices of the centres, the
    position of each one's parent in the level above, and the distance to its
    farthest descendant.  A centre stays a centre on every level below.  The last
    level holds every vector, with radius 0.
    """

    def __init__(self, x: np.ndarray, least: float):
        n = len(x)
        self.x = x
        dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ x.T)))
        np.fill_diagonal(dist, 0.0)
        owner = np.zeros(n, np.int64)  # position of each vector's centre in the level
        centres = np.zeros(1, np.int64)
        self.levels = [(centres, np.zeros(1, np.int64), np.array([dist[0].max()]))]
        radius = 2.0
        while len(centres) < n:
            radius /= 2
            if radius < least:  # below the threshold: single vectors
                new_centres, parents = np.arange(n), owner
                owner = np.arange(n)
            else:
                new_centres, parents, new_owner = [], [], np.empty(n, np.int64)
                by_node = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[by_node], np.arange(len(centres)), side="right")
                for node, (start, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                    rest = by_node[start:end]
                    centre = centres[node]  # nested: the node's centre comes first
                    while len(rest):
                        near = dist[centre, rest] <= radius
                        new_owner[rest[near]] = len(new_centres)
                        new_centres.append(centre)
                        parents.append(node)
                        rest = rest[~near]
                        centre = rest[0] if len(rest) else -1
                new_centres, parents = np.array(new_centres), np.array(parents)
                owner = new_owner
            radii = np.zeros(len(new_centres))
            np.maximum.at(radii, owner, dist[new_centres[owner], np.arange(n)])
            centres = new_centres
            self.levels.append((centres, parents, radii))
            if radius < least:
                break


def dual_pairs(a: CoverTree, b: CoverTree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``(i, j)`` of all vector pairs within ``reach`` (and maybe a few just
    beyond it): walks both trees level by level and drops every node pair whose
    centres are farther apart than both radii and ``reach`` allow."""
    alive = np.ones((1, 1), bool)
    for level in range(max(len(a.levels), len(b.levels))):
        sides = []
        for t in (a, b):
            if level < len(t.levels):
                sides.append(t.levels[level])
            else:  # this tree has ended: its vectors stay
                centres, _, radii = t.levels[-1]
                sides.append((centres, np.arange(len(centres)), radii))
        (ca, pa_, ra), (cb, pb, rb) = sides
        if level:
            alive = alive[pa_][:, pb]
        rows, cols = alive.any(axis=1), alive.any(axis=0)
        kept = np.zeros_like(alive)
        i, j = np.flatnonzero(rows), np.flatnonzero(cols)
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.x[ca[i]] @ b.x[cb[j]].T)))
        near = d <= ra[i][:, None] + rb[j][None, :] + reach + SLOP
        kept[np.ix_(i, j)] = near & alive[np.ix_(i, j)]
        alive = kept
    i, j = np.nonzero(alive)
    return a.levels[-1][0][i], b.levels[-1][0][j]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def _reach(cosine: float) -> float:
    return math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLOP


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, so that no square overflows or vanishes."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> np.ndarray:
    x = _scaled(raw)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _classes(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, digest, v``: v the vector as doubles, digest null where
    the row can link with nothing."""
    def run(batches):
        for batch in batches:
            digest, raw, dims = [], [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = v.values
                ok = label is not None and x is not None and len(x) and not x.null_count
                if ok:
                    x = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0 is 0
                    ok = bool(np.isfinite(x).all() and x.any())
                dims.append(len(x) if ok else None)
                raw.append(x.tobytes() if ok else None)
                digest.append(hashlib.blake2b(repr(label).encode() + b":" + x.tobytes(),
                                              digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.string()), pa.array(dims, pa.int32()),
                 pa.array(digest, pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "label", "dim", "digest", "v"])

    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>")) \
        .mapInArrow(run, "vec_id long, label string, dim int, digest binary, v binary")


def _pivots(reps: DataFrame, per_label: int) -> np.ndarray | None:
    """Far-apart vectors of a bounded sample: the top of a cover tree."""
    want = min(PIVOTS, -(-per_label // BLOCK))
    if want < 2:
        return None
    dim = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    sample = reps.filter(F.col("dim") == dim).orderBy(F.xxhash64("digest")).limit(PIVOT_SAMPLE)
    x = _unit(_stack([r.v for r in sample.select("v").collect()]))
    chosen, far = [0], 2.0 - 2.0 * (x @ x[0])
    while len(chosen) < min(want, len(x)) and far.max() > SLOP:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2.0 - 2.0 * (x @ x[chosen[-1]]))
    return x[chosen]


def _cells(reps: DataFrame, pivots: np.ndarray | None) -> DataFrame:
    """Adds each class's cell (nearest pivot) and its distance from the pivot."""
    def run(batches):
        for batch in batches:
            cell, away = [], []
            for v in batch.column("v").to_pylist():
                x = np.frombuffer(v, np.float64)
                if pivots is None or len(x) != pivots.shape[1]:
                    cell.append(-1), away.append(2.0)
                else:
                    d = 2.0 - 2.0 * (pivots @ _unit(x[None])[0])
                    cell.append(int(d.argmin())), away.append(math.sqrt(max(0.0, d.min())))
            yield batch.append_column("cell", pa.array(cell, pa.int32())) \
                       .append_column("away", pa.array(away, pa.float64()))

    return reps.mapInArrow(run, "digest binary, label string, dim int, rep long, n long, v binary, "
                                "cell int, away double")


def threshold_links(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of
    ``vectors(vec_id, embedding, label)``.

    Two vectors are linked when their labels are equal and not null and their cosine
    in double precision is at least ``cosine``.  ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest vec_id reachable and ``kept``
    marks it.  Rows with a null label, a null, empty or zero vector, or null or
    non-finite components link with nothing, as do vectors of different length;
    rows without vec_id have component_id null and kept true.  Repeated rows are
    linked with each other.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = persist_shared(_classes(vectors), "vectors")
    named = rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL")
    reps = persist_shared(
        named.groupBy("digest").agg(F.min(F.struct("vec_id", "label", "dim", "v")).alias("m"),
                                    F.count(F.lit(1)).alias("n"))
             .select("digest", "m.label", "m.dim", F.col("m.vec_id").alias("rep"), "n", "m.v"), "classes")
    most = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    pivots = _pivots(reps, most)
    cells = persist_shared(_cells(reps, pivots), "cells")

    key = ["label", "dim", "cell"]
    parts = cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = cells.join(parts, key).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts"))) \
                 .withColumn("block", F.xxhash64(*key, "part"))
    blocks = dealt.groupBy("label", "dim", "cell", "block").agg(F.max("away").alias("radius"))
    # block pairs by label: an equi-join of block rows, not of vectors
    x = blocks.select("label", "dim", *[F.col(c).alias(f"{c}_a") for c in ("cell", "block", "radius")])
    y = blocks.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("cell", "block", "radius")])
    pairs = x.join(y, ["label", "dim"]).filter("block_a <= block_b")
    if pivots is not None:
        apart = [[float(v) for v in row] for row in
                 np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots @ pivots.T)))]
        gaps = F.broadcast(spark.createDataFrame(  # at most PIVOTS ** 2 numbers
            [(i, row) for i, row in enumerate(apart)], "cell_a int, gaps array<double>"))
        pairs = pairs.join(gaps, "cell_a", "left").filter(
            "cell_a < 0 OR cell_b < 0 OR gaps[cell_b] <= radius_a + radius_b + "
            f"{_reach(cosine) + 10 * SLOP}")
    pairs = pairs.select("block_a", "block_b")
    sides = pairs.select(F.col("block_a").alias("block"), "block_a", "block_b", F.lit(0).alias("side")) \
        .unionByName(pairs.filter("block_a <> block_b").select(
            F.col("block_b").alias("block"), "block_a", "block_b", F.lit(1).alias("side")))
    moved = dealt.select("block", "rep", "n", "v").join(sides, "block") \
                 .select("block_a", "block_b", "side", "rep", "n", "v")
    reach = _reach(cosine)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        trees, ids, sizes, raw = [], [], [], []
        for _, g in pdf.groupby("side"):
            g = g.sort_values("rep")
            v = _scaled(_stack(g["v"].tolist()))
            raw.append(v)
            trees.append(CoverTree(_unit(v), reach / 2))
            ids.append(g["rep"].to_numpy())
            sizes.append(g["n"].to_numpy())
        own = len(trees) == 1
        i, j = dual_pairs(trees[0], trees[-1], reach)
        if own:
            i, j = i[i < j], j[i < j]
        keep = np.empty(len(i), bool)
        for at in range(0, len(i), 65536):  # bounded: many links are one block's square
            s = slice(at, at + 65536)
            keep[s] = _cosines(raw[0][i[s]], raw[-1][j[s]]) >= cosine
        i, j = i[keep], j[keep]
        na, nb = np.zeros(len(ids[0]), np.int64), np.zeros(len(ids[-1]), np.int64)
        np.add.at(na, i, sizes[-1][j])
        np.add.at(nb, j, sizes[0][i])
        edges = spanning(ids[0][i], ids[-1][j])
        ia, ib = np.flatnonzero(na), np.flatnonzero(nb)
        return pd.DataFrame({
            "u": np.concatenate([ids[0][ia], ids[-1][ib], [e[0] for e in edges]]).astype("int64"),
            "v": np.concatenate([ids[0][ia], ids[-1][ib], [e[1] for e in edges]]).astype("int64"),
            "links": np.concatenate([na[ia], nb[ib], np.zeros(len(edges))]).astype("int64")})

    found = persist_shared(moved.groupBy("block_a", "block_b").applyInPandas(
        compare, "u long, v long, links long"), "found")
    links = found.filter("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    label = components(found.filter("u <> v").select("u", "v"))

    final = reps.select("digest", "rep", "n") \
        .join(links, "rep", "left") \
        .join(label.select(F.col("node").alias("rep"), "component"), "rep", "left") \
        .select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    linked = named.select("vec_id", "digest").join(final, "digest") \
                  .select("vec_id", "n_links", "component_id")
    alone = rows.filter("digest IS NULL OR vec_id IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same links in DuckDB: all pairs of a label, components by recursion.
LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
  SELECT DISTINCT u AS node, u AS seen FROM l
  UNION
  SELECT r.node, l.v FROM r JOIN l ON r.seen = l.u),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links,
       coalesce(c.component, e.vec_id) AS component_id,
       coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
