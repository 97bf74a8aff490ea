"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has SLOTS b-bit MinHash values.  It is cut into chunks of
CHUNK slots.  Two signatures that differ in at most ``distance()`` slots differ in
at most ERRORS slots of some chunk (pigeonhole), so indexing every chunk under
each choice of ERRORS left-out slots brings every such pair together.  Pairs that
meet are compared on whole signatures, then confirmed on full shingle sets.

Equal sets are one class from the start, so copies never meet.  In each bucket the
class that shares the most keys with others is the hub; every other member is
compared with it, and what that links is one component.  A class's cell is its best
hub.  Members of a cell outside the hub's component are then compared with the rest
of the cell, block by block inside a task, and members of a bucket that belong to
different cells pair by pair.  So every two classes that meet are either connected
already or compared, and the pairs inside a group of near copies are never listed.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.llm.common import ascii_lower, persist_shared, words
from cribra.llm.graph import components, spanning

SLOTS, BITS, CHUNK, ERRORS = 65, 16, 5, 1
#: Signatures may differ in this many slots more than the guarantee before a pair
#: that met anyway is given up without comparing its sets.
SLACK = 7
#: Hash slots of doc_id (numbers in one broadcast table at most).
ID_SLOTS = 1 << 20
#: Classes of a block, and shingles it should hold on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1 << 20

_U = np.uint64
_MIX1, _MIX2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def distance() -> int:
    """Every pair within this many differing slots is compared."""
    return (SLOTS // CHUNK) * (ERRORS + 1) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text from its word hashes.

    ``flat`` holds the word hashes (uint64) of all texts, ``offsets`` the ends.  A
    text of fewer than ``width`` words is one shingle; without words, none.
    """
    n = np.diff(offsets)
    rolled = np.zeros(max(0, len(flat) - width + 1), _U)
    for j in range(width):
        rolled = _mix(rolled * _STEP + flat[j:j + len(rolled)] + _U(j + 1))
    out = []
    for start, k in zip(offsets[:-1], n):
        if k >= width:
            out.append(np.unique(rolled[start:start + k - width + 1]))
        elif k:
            h = np.array([k], _U)
            for w in flat[start:start + k]:
                h = _mix(h * _STEP + w)
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 2**32, SLOTS, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 2**32, SLOTS, dtype=np.uint32))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``len(sets) x SLOTS`` b-bit minima; sets must not be empty."""
    if not sets:
        return np.zeros((0, SLOTS), np.uint16)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    mult, add = _permutations()
    out = np.empty((len(sets), SLOTS), np.uint16)
    v = np.empty_like(x)
    for i in range(SLOTS):
        np.multiply(x, mult[i], out=v)
        np.add(v, add[i], out=v)
        out[:, i] = (np.minimum.reduceat(v, starts) & np.uint32((1 << BITS) - 1)).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: one per chunk and choice of left-out slots."""
    cols = []
    for c in range(0, SLOTS - CHUNK + 1, CHUNK):
        for keep in combinations(range(c, c + CHUNK), CHUNK - ERRORS):
            h = np.full(len(sig), len(cols) + 1, _U)
            for k in keep:
                h = _mix(h * _STEP + sig[:, k].astype(_U))
            cols.append(h)
    return np.stack(cols, axis=1)


def _word_arrays(docs: DataFrame, *extra: str | Column) -> DataFrame:
    """doc_id and the word hashes of the lower-cased text, made in the JVM."""
    return docs.select("doc_id", *extra,
                       F.transform(words(ascii_lower(F.col("text"))), lambda w: F.xxhash64(w)).alias("w"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(_U)
    return flat[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = shingle_sets(*_lists(batch.column(2)), width)
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full))
            rows = [(_digest(s), next(sigs).tobytes()) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.binary())],
                ["doc_id", "text_id", "n_shingles", "digest", "sig"])

    return _word_arrays(docs, _text_id(F.col("text")).alias("text_id")).mapInArrow(
        run, "doc_id long, text_id binary, n_shingles long, digest binary, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            keys = index_keys(sig.reshape(-1, SLOTS))
            reps = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures are close enough."""
    most = distance() + SLACK
    s = classes.select("rep", "sig")
    j = pairs.join(s.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a") \
             .join(s.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16)
                    .reshape(-1, SLOTS) for i in (2, 3))
            ok = pa.array((x != y).sum(axis=1) <= most)
            yield batch.select(["a", "b"]).filter(ok)

    return j.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``rep, s``: the full shingle sets of the classes ``wanted(rep, first, digest)``;
    ``first`` is a document of the class.

    Most documents are not wanted: those whose hash slot nobody asks for go before
    their texts are shuffled.  At most ID_SLOTS slots are broadcast.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_SLOTS)).alias("slot")
    texts = docs.select("doc_id", "text", slot("doc_id")) \
        .join(F.broadcast(wanted.select(slot("first")).distinct()), "slot", "left_semi") \
        .join(wanted.select(F.col("first").alias("doc_id"), "rep", "digest"), "doc_id")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = shingle_sets(*_lists(batch.column(3)), width)
            # a repeated doc_id may carry other texts: keep the class's own
            same = [_digest(s) == d for s, d in zip(found, batch.column(2).to_pylist())]
            out = pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([s.tobytes() for s in found], pa.binary())], ["rep", "s"])
            yield out.filter(pa.array(same))

    return _word_arrays(texts, "rep", "digest").mapInArrow(run, "rep long, s binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``(u, v)``: the pairs whose full sets are similar enough."""
    j = pairs.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b") \
             .join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"])
            yield out.filter(pa.array(ok, pa.bool_()))

    return persist_shared(
        j.select("a", "b", "sa", "sb").mapInArrow(check, "u long, v long"), "links")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(left), len(right)), np.float32)
    at = []
    for row, f in zip(rows, flat):
        col = np.searchsorted(common, f)
        col[col == len(common)] = 0
        hit = common[col] == f if len(common) else np.zeros(len(f), bool)
        order = np.argsort(col[hit], kind="stable")
        at.append((row[hit][order], col[hit][order]))
    for start in range(0, len(common), 4096):
        part = []
        for (row, col), side in zip(at, (left, right)):
            lo, hi = np.searchsorted(col, [start, start + 4096])
            m = np.zeros((len(side), 4096), np.float32)
            m[row[lo:hi], col[lo:hi] - start] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _blocks(members: DataFrame, count) -> DataFrame:
    """``members(cell, stray, rep, ...)`` in pairs of blocks: adds ``task`` and ``side``.

    Strays are to meet the strays and the others of their cell.  ``count`` gives an
    aggregate for the number of blocks of the rows that a condition picks; members are
    dealt to blocks by hash.  A cell without strays gives no rows.
    """
    cells = members.groupBy("cell").agg(
        count(F.col("stray")).alias("strays"), count(~F.col("stray")).alias("mains")).filter("strays > 0")
    upto = lambda first, n: F.when(n > first, F.sequence(first, n - 1)) \
        .otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    pairs = cells.select("cell", "strays", "mains", F.explode(upto(zero, F.col("strays"))).alias("i")) \
        .select("cell", "i", F.explode(F.concat(
            F.transform(upto(F.col("i"), F.col("strays")), lambda j: F.struct(F.lit(True).alias("stray"), j.alias("part"))),
            F.transform(upto(zero, F.col("mains")), lambda j: F.struct(F.lit(False).alias("stray"), j.alias("part")))))
            .alias("other"))
    task = F.struct("i", F.col("other.stray").alias("stray"), F.col("other.part").alias("part"))
    sides = pairs.select("cell", F.lit(True).alias("stray"), F.col("i").alias("part"), task.alias("task"),
                         F.lit(0).alias("side")) \
        .unionByName(pairs.filter("NOT other.stray OR other.part <> i").select(
            "cell", "other.stray", "other.part", task.alias("task"), F.lit(1).alias("side")))
    dealt = members.join(cells, "cell").withColumn("part", F.pmod(
        F.xxhash64("rep"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains"))).cast("int"))
    return dealt.join(sides, ["cell", "stray", "part"]).select(
        *members.columns, F.xxhash64("task").alias("task"), "side")


def _within_cells(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``(u, v)`` that join what is not connected yet inside a cell.

    ``members``: rep, cell, n_shingles, comp and stray (outside the hub's component).
    Strays meet strays and the hub's component in blocks; a cell without strays
    costs nothing.
    """
    count = lambda cond: F.greatest(
        F.ceil(F.count_if(cond) / BLOCK_CLASSES),
        F.ceil(F.sum(F.when(cond, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    moved = _blocks(members, count).select("rep", "comp", "cell", "task", "side").join(sets, "rep") \
        .select("cell", "task", "side", "rep", "comp", "s")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [g for _, g in pdf.groupby("side")]
        x, y = sides[0], sides[-1]
        a, b = ([np.frombuffer(s, _U) for s in g["s"]] for g in (x, y))
        both = overlaps(a, b)
        sizes = [np.array([len(s) for s in side], np.float64) for side in (a, b)]
        near = 100.0 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
        near &= x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :]
        i, j = np.nonzero(near)
        edges = spanning(x["comp"].to_numpy()[i], y["comp"].to_numpy()[j])
        return pd.DataFrame(edges, columns=["u", "v"]).astype("int64")

    return moved.groupBy("cell", "task").applyInPandas(compare, "u long, v long")


def _across_cells(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different cells whose signatures are close enough.

    ``members(cell, rep, own, comp, stray)``: here a cell is a bucket, ``own`` the cell of
    a member and a stray one that is not of the hub's.  Blocks of a bucket meet inside a
    task, which sends on only the pairs that are close, so rows do not grow with the
    square of a bucket.  Two classes may share many buckets; the one of their first
    common key gives the pair.
    """
    most = distance() + SLACK
    count = lambda cond: F.ceil(F.count_if(cond) / BLOCK_CLASSES).cast("int")
    moved = _blocks(members, count).join(classes.select("rep", "sig"), "rep")
    groups = moved.groupBy("cell", "task").agg(  # at most two blocks
        F.collect_list(F.struct("side", "rep", "own", "comp", "sig")).alias("m"))

    def run(batches):
        for batch in batches:
            for key, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                side, rep, own, comp = (m.values.field(c).to_numpy() for c in ("side", "rep", "own", "comp"))
                sig = np.frombuffer(b"".join(m.values.field("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
                x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                alone = not len(y)
                y = x if alone else y
                found = []
                for at in range(0, len(x), 64):
                    i = x[at:at + 64]
                    ok = (own[i][:, None] != own[y][None, :]) & (comp[i][:, None] != comp[y][None, :])
                    p, q = np.nonzero(ok)
                    if alone:
                        p, q = p[i[p] < y[q]], q[i[p] < y[q]]
                    a, b = i[p], y[q]
                    for part in np.array_split(np.arange(len(a)), max(1, len(a) >> 16)):
                        near = part[(sig[a[part]] != sig[b[part]]).sum(axis=1) <= most]
                        if len(near):
                            ka, kb = index_keys(sig[a[near]]), index_keys(sig[b[near]])
                            first = ka[np.arange(len(near)), (ka == kb).argmax(axis=1)]
                            near = near[first.view(np.int64) == key]
                            found.append((rep[a[near]], rep[b[near]]))
                if found:
                    a, b = (np.concatenate(f) for f in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return groups.select("cell", "m").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Words are lower-cased (A-Z) and cut at ASCII white space; a document's set is
    its distinct ``width``-word shingles (the whole text as one if it is shorter).
    Documents with ``100 * intersection >= percent * union`` are linked;
    ``component_id`` is the smallest doc_id reachable and ``kept`` marks it.

    Null, empty and blank texts have an empty set and link with nothing, as do rows
    without doc_id (component_id null, kept true).  Rows that repeat a doc_id are
    the same document, each decided by its own text.  Other columns are ignored.
    """
    return _decided(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _decided(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``text_id``, ``digest`` (null: no shingles) and the number
    of the ``group``: two groups may have one smallest doc_id."""
    sketched = persist_shared(_sketches(docs, width), "sketches")
    named = sketched.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = persist_shared(
        named.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("m"))
             # a document with several texts is first in several classes: number them
             .select("digest", F.monotonically_increasing_id().alias("rep"),
                     F.col("m.doc_id").alias("first"), "m.n_shingles", "m.sig"), "classes")

    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"),
                                     F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("key", "n")
    met = persist_shared(keys.join(shared, "key"), "met")
    degree = met.groupBy("rep").agg(F.sum("n").alias("degree"))
    met = met.join(degree, "rep")
    hubs = met.groupBy("key").agg(F.max(F.struct("degree", "rep")).alias("hub"))
    buckets = persist_shared(met.select("key", "rep").join(hubs, "key"), "buckets")
    cells = persist_shared(
        buckets.groupBy("rep").agg(F.max("hub").alias("hub")).select("rep", F.col("hub.rep").alias("cell"))
               .join(classes.select("rep", "first", "n_shingles", "digest"), "rep"), "cells")
    sets = persist_shared(_full_sets(docs, cells, width).dropDuplicates(["rep"]), "sets")

    # every member of a bucket against its hub
    pairs = buckets.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).filter("a <> b").distinct()
    linked = persist_shared(components(_confirm(persist_shared(_near(pairs, classes), "pairs"), sets, percent)),
                            "components")
    label = lambda c: linked.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))

    # inside each cell
    members = cells.join(label("rep"), "rep", "left").join(label("cell"), "cell", "left") \
        .select("rep", "cell", "n_shingles", F.coalesce("c_rep", "rep").alias("comp"),
                F.coalesce("c_cell", "cell").alias("main")) \
        .withColumn("stray", F.col("comp") != F.col("main"))
    members = persist_shared(members, "members")
    inside = persist_shared(_within_cells(members, sets, percent), "inside")

    # buckets over several cells: across them
    b = buckets.select("key", "rep", F.col("hub.rep").alias("hub")) \
               .join(members.select("rep", "cell", "comp"), "rep")
    mixed = b.groupBy("key").agg(
        F.min("cell").alias("lo"), F.max("cell").alias("hi"),
        F.max(F.when(F.col("rep") == F.col("hub"), F.col("cell"))).alias("main")) \
        .filter("lo <> hi").select("key", "main")
    mixed = persist_shared(b.join(mixed, "key").select(
        F.col("key").alias("cell"), "rep", F.col("cell").alias("own"), "comp",
        (F.col("cell") != F.col("main")).alias("stray")), "mixed")
    across = _confirm(persist_shared(_across_cells(mixed, classes), "across"), sets, percent)
    across = across.join(label("u"), "u", "left").join(label("v"), "v", "left") \
                   .select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
    joined = components(inside.unionByName(across))

    final = classes.select("digest", "rep", "first").join(label("rep"), "rep", "left") \
        .withColumn("c", F.coalesce("c_rep", "rep")) \
        .join(joined.select(F.col("node").alias("c"), F.col("component").alias("c2")), "c", "left") \
        .select("digest", "first", F.coalesce("c2", "c").alias("c"))
    final = persist_shared(final, "final")
    least = final.groupBy("c").agg(F.min("first").alias("component_id"))
    final = final.join(least, "c").select("digest", "component_id", F.col("c").alias("group"))
    found = named.join(final, "digest").select("doc_id", "text_id", "digest", "n_shingles", "component_id", "group")
    alone = sketched.filter("digest IS NULL OR doc_id IS NULL") \
                    .select("doc_id", "text_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"),
                            F.lit(None).cast("long").alias("group"))
    return found.unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, of the smallest doc_id.

    All columns stay.  Rows without doc_id or words stay.  Where a doc_id carries
    several texts, each is dropped or kept by its own group; rows that repeat a doc_id
    and its text stay once.
    """
    found = persist_shared(_decided(docs, width, percent).filter("digest IS NOT NULL AND doc_id IS NOT NULL")
                           .groupBy("group", "doc_id", "text_id").agg(F.count(F.lit(1)).alias("n")), "decided")
    stay = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_id", "n")).alias("m")).select("m.*")
    gone = found.join(stay, ["doc_id", "text_id"], "left_anti").select("doc_id", "text_id", F.lit(True).alias("gone"))
    more = stay.filter("n > 1").select("doc_id", "text_id", F.lit(False).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", _text_id(F.col("text")).alias("text_id")) \
               .join(gone.unionByName(more), ["doc_id", "text_id"], "left")
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_id").orderBy(F.xxhash64("row")))
    once = rows.filter("NOT gone").withColumn("turn", turn).filter("turn = 1")
    return rows.filter("gone IS NULL").select("row.*").unionByName(once.select("row.*"))


#: The same components in DuckDB, for 4-word shingles: all pairs that share a shingle.
NEAR_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (
  SELECT DISTINCT u AS node, u AS seen FROM e
  UNION
  SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       coalesce(c.component, d.doc_id) AS component_id,
       coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
