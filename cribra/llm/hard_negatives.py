"""Hard negatives by segment summary filtering.

Each vector is cut into segments; a segment's mean and deviation are stored with it.
The inner product of two vectors lies within the sum of the segments' products of
means, plus or minus the sum of their products of deviations (Cauchy-Schwarz on what
the means leave).  One segment is tried first, then each is cut into FANOUT, and so on
(coarser summaries follow from the finest): a pair goes as soon as its bounds cannot
reach what is asked for, and only the rest is scored exactly.

Anchors are a stated query set against all rows: blocks of anchors meet blocks of
rows, one block pair in a task, tile by tile, and each returns its best few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cribra.llm.common import persist_shared

#: Segments of the finest summary, and how many one is cut into.
SEGMENTS, FANOUT = 16, 4
#: Anchors and rows of a block, and rows of a tile inside a task.
ANCHORS, ROWS, TILE = 1024, 8192, 1024
#: Sums of squares from here on would not fit a 64-bit score.
TOO_LARGE = 2.0 ** 62
#: Whole numbers below it have doubles of their own.  A tile is scored whole where one
#: pair of so many is left.
EXACT, DENSE = 2.0 ** 52, 16


def _cuts(dim: int) -> np.ndarray:
    n = min(SEGMENTS, dim)
    return np.arange(n + 1) * dim // n


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (root of the summed squares) of every segment."""
    cuts = _cuts(x.shape[1])
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / np.diff(cuts)
    rest = x - np.repeat(mean, np.diff(cuts), axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1))


def coarser(mean: np.ndarray, dev: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Summaries from one segment to the finest, means times the root of the length."""
    size = np.diff(_cuts(dim)).astype(np.float64)
    out = []
    while True:
        out.append((mean * np.sqrt(size), dev))
        if len(size) == 1:
            return out[::-1]
        at = np.arange(0, len(size), FANOUT)
        length = np.add.reduceat(size, at)
        up = np.add.reduceat(mean * size, at, axis=1) / length
        own = np.repeat(up, np.diff(np.append(at, len(size))), axis=1)
        dev = np.sqrt(np.add.reduceat(dev * dev + size * (mean - own) ** 2, at, axis=1))
        mean, size = up, length


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def surviving(a: list, b: list, can: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(anchor, row)`` among ``can`` that bounds cannot rule out, level by level.

    ``wanted(anchors, low, high, alive)`` says which pairs may still be asked for.
    """
    i, j, alive = np.arange(can.shape[0]), np.arange(can.shape[1]), can
    for (ma, da), (mb, db) in zip(a, b):
        rows, cols = alive.any(axis=1), alive.any(axis=0)
        if not rows.any():
            break
        i, j, alive = i[rows], j[cols], alive[rows][:, cols]
        mid, spread = ma[i] @ mb[j].T, da[i] @ db[j].T
        spread *= 1 + 1e-9  # rounding
        spread += 1e-9 * max(mid.max(), -mid.min()) + 1e-6
        alive = alive & wanted(i, mid - spread, mid + spread, alive)
    found = np.nonzero(alive)
    return i[found[0]], j[found[1]]


def _scores(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray, t: slice) -> np.ndarray:
    """Exact inner products of rows ``i`` of ``a`` and ``j`` of tile ``t`` of ``b``.  Where
    bounds left much of the tile it is multiplied whole, in doubles that hold every sum."""
    y = b.x[t]
    if len(i) * DENSE >= len(a.x) * len(y) and a.norm * b.norm < EXACT:
        return (a.x.astype(np.float64) @ y.astype(np.float64).T)[i, j].astype(np.int64)
    return np.einsum("ij,ij->i", a.x[i], y[j])


def _prepared(vectors: DataFrame, shift_every: int, labels: int) -> DataFrame:
    """``row, vec_id, label, dim, v, mean, dev``: rows that take part, whole numbers."""
    label = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))

    def run(batches):
        for batch in batches:
            keep, dims, out = [], [], []
            for k, v in enumerate(batch.column("e")):
                x = v.values
                if x is None or not len(x) or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    x = np.floor(256.0 * x)
                    if not np.isfinite(x).all() or x @ x >= TOO_LARGE:
                        continue
                mean, dev = summaries(x[None])
                keep.append(k), dims.append(len(x))
                out.append((x.astype(np.int64).tobytes(), mean.tobytes(), dev.tobytes()))
            rest = batch.select(["row", "vec_id", "label"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(dims, pa.int32()),
                 *[pa.array([o[c] for o in out], pa.binary()) for c in range(3)]],
                ["row", "vec_id", "label", "dim", "v", "mean", "dev"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("e")) \
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL")
    return rows.mapInArrow(run, "row long, vec_id long, label long, dim int, v binary, mean binary, dev binary")


class _Side:
    """Vectors of a block with their summaries by level."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        n = len(pdf)
        self.x = np.frombuffer(b"".join(pdf["v"]), np.int64).reshape(n, dim)
        mean, dev = (np.frombuffer(b"".join(pdf[c])).reshape(n, -1) for c in ("mean", "dev"))
        self.levels = coarser(mean, dev, dim)
        self.norm = max((float(v @ v) for v in self.x.astype(np.float64)), default=0.0) ** 0.5
        self.row, self.vec_id, self.label = (pdf[c].to_numpy() for c in ("row", "vec_id", "label"))

    def tiles(self, rows: int):
        for at in range(0, len(self.row), rows):
            yield slice(at, at + rows)


def _block_pairs(anchors: DataFrame, rows: DataFrame, group: list[str], *more: str) -> DataFrame:
    """Every block of anchors beside every block of rows of its group: ``task``, ``side``
    (0 anchors) and the vectors.  Blocks are dealt by hash from counts of their group,
    so no group meets in one task."""
    def dealt(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        parts = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
        return df.join(parts, group).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")), parts

    a, na = dealt(anchors, ANCHORS)
    b, nb = dealt(rows, ROWS)
    pairs = na.withColumnRenamed("parts", "pa").join(nb.withColumnRenamed("parts", "pb"), group)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = ["row", "vec_id", "label", "dim", "v", "mean", "dev", *more]
    each = lambda df, other, side: df.join(pairs, group).select(
        *columns, F.col("part").alias("own"),
        F.explode(upto(other)).alias("met"), F.lit(side).alias("side"),
        F.xxhash64(*group).alias("group"))
    left = each(a, "pb", 0).withColumn("task", F.struct("group", F.col("own").alias("a"), F.col("met").alias("b")))
    right = each(b.withColumns({c: F.lit(None).cast(dict(anchors.dtypes)[c]) for c in more}), "pa", 1) \
        .withColumn("task", F.struct("group", F.col("met").alias("a"), F.col("own").alias("b")))
    return left.unionByName(right).select("task", "side", *columns)


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, _Side, _Side] | None:
    a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    dim = int(pdf["dim"].iloc[0])
    return (a, _Side(a, dim), _Side(b, dim)) if len(a) and len(b) else None


def _best(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of each key: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, keys))
    keys = keys[order]
    first = np.searchsorted(keys, keys)
    return order[np.arange(len(keys)) - first < k]


def _positives(prepared: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``row, positive_id, positive_score, nth``: the first k others of the anchor's label."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, sides = [], _sides(pdf)
        if sides:
            _, a, b = sides
            floor = np.full(len(a.row), -np.inf)  # k-th best score so far
            for t in b.tiles(TILE):
                can = a.row[:, None] != b.row[t][None, :]

                def wanted(i, low, high, alive):
                    return high >= np.maximum(floor[i], _kth(np.where(alive, low, -np.inf), k))[:, None]

                i, j = surviving(a.levels, [(m[t], d[t]) for m, d in b.levels], can, wanted)
                scores = _scores(a, i, b, j, t)
                j = j + t.start
                best = _best(i, b.vec_id[j], scores, k)
                out.append(pd.DataFrame({"row": a.row[i[best]], "positive_id": b.vec_id[j[best]],
                                         "positive_score": scores[best], "p": b.row[j[best]]}))
                n = np.bincount(i[best], minlength=len(floor))
                worst = np.full(len(floor), np.inf)
                np.minimum.at(worst, i[best], scores[best])
                floor = np.maximum(floor, np.where(n >= k, worst, -np.inf))
        columns = ["row", "positive_id", "positive_score", "p"]
        return (pd.concat(out) if out else pd.DataFrame(columns=columns)).astype("int64")

    found = _block_pairs(anchors, prepared, ["label", "dim"]).groupBy("task").applyInPandas(
        run, "row long, positive_id long, positive_score long, p long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "p")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("p")


def _negatives(prepared: DataFrame, anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """``row, nth, negative_id, negative_score, rank``: the first k rows of other labels
    whose score times 100 lies between ``low`` and ``high`` times the positive's."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, sides = [], _sides(pdf)
        if sides:
            own, a, b = sides
            slots = max(len(p) for p in own["scores"])
            # whole bounds of what is asked for; a missing positive asks for nothing
            least, most = (np.full((len(a.row), slots), f) for f in (np.inf, -np.inf))
            for r, p in enumerate(own["scores"]):
                least[r, :len(p)] = [-(-low * int(s) // 100) for s in p]
                most[r, :len(p)] = [high * int(s) // 100 for s in p]
            none = least > most
            least[none], most[none] = np.inf, -np.inf
            top = most.max(axis=1)
            floor = np.full(least.shape, -np.inf)  # k-th best score so far
            for t in b.tiles(TILE):
                can = a.label[:, None] != b.label[t][None, :]

                # what any positive may still ask for: one test of a pair for all of them
                reach = np.maximum(least, floor).min(axis=1)

                def wanted(i, lo, hi, alive):
                    return (hi >= reach[i][:, None]) & (lo <= top[i][:, None])

                i, j = surviving(a.levels, [(m[t], d[t]) for m, d in b.levels], can, wanted)
                scores = _scores(a, i, b, j, t)
                j = j + t.start
                for s in range(slots):
                    hit = np.flatnonzero((scores >= np.maximum(least, floor)[i, s]) & (scores <= most[i, s]))
                    best = hit[_best(i[hit], b.vec_id[j[hit]], scores[hit], k)]
                    out.append(pd.DataFrame({"row": a.row[i[best]], "nth": s + 1, "negative_id": b.vec_id[j[best]],
                                             "negative_score": scores[best], "n": b.row[j[best]]}))
                    n = np.bincount(i[best], minlength=len(floor))
                    worst = np.full(len(floor), np.inf)
                    np.minimum.at(worst, i[best], scores[best])
                    floor[:, s] = np.maximum(floor[:, s], np.where(n >= k, worst, -np.inf))
        columns = ["row", "nth", "negative_id", "negative_score", "n"]
        return (pd.concat(out) if out else pd.DataFrame(columns=columns)).astype("int64")

    found = _block_pairs(anchors, prepared, ["dim"], "scores").groupBy("task").applyInPandas(
        run, "row long, nth long, negative_id long, negative_score long, n long")
    order = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id", "n")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("n")


def hard_negatives(vectors: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors(vec_id, embedding, label)``: where ``shift_every`` divides vec_id the label
    becomes ``(label + 1) % labels`` first, and each component x ``floor(256 * x)``.  A
    score is the whole inner product with the anchor; higher ones come first, ties by
    smaller vec_id.  Anchors are the rows whose vec_id ``anchor_every`` divides, their
    positives the first ``positives`` other rows of the same label.  For each, the first
    ``negatives`` rows of other labels come back with ``low * positive_score <= 100 *
    negative_score <= high * positive_score``.

    Rows with a null vec_id, label or vector, an empty vector, or null or non-finite
    components take no part, nor do vectors whose squares sum to 2 ** 62 or more, whose
    scores might not fit a long.  Vectors meet those of their own length.  Rows that
    repeat a vec_id are rows of their own.  An empty table gives no rows; other columns
    are ignored.
    """
    prepared = persist_shared(_prepared(vectors, shift_every, labels), "prepared")
    anchors = prepared.filter(F.col("vec_id") % anchor_every == 0)
    near = persist_shared(_positives(prepared, anchors, positives), "positives")
    scores = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))),
                                                 lambda p: p["positive_score"]).alias("scores"))
    found = _negatives(prepared, anchors.join(scores, "row"), negatives, low, high)
    return found.join(near, ["row", "nth"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row") \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                "positive_score", "negative_score")


#: The same in DuckDB: every anchor against every row.
MINE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
