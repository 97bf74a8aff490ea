"""Merkle manifest of a dataset as postorder append logs.

Leaves are dealt to aligned builders: builder ``b`` of a tree gets its inputs ``b *
BLOCK`` to ``(b + 1) * BLOCK - 1``, hashes every FAN consecutive nodes into one and
appends each node to its segment as soon as it is complete, so a segment is the
postorder of its subtree.  A segment's top is an input of the next tier, until a tree
has one node.  All earlier segments of a tree are full, so the address of any node is
a closed form of its level and index; proofs read siblings by these addresses from
the one segment that holds them and go on with the path of the segment's top.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import ascii_lower, persist_shared, ranked

#: Nodes of a run, levels of a builder, inputs of a builder.
FAN, HEIGHT = 16, 3
BLOCK = FAN ** HEIGHT
#: Nodes of a full segment.
SEGMENT = (FAN ** (HEIGHT + 1) - 1) // (FAN - 1)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def height(block: int, n: int, most: int) -> int:
    """Levels that a builder of ``n`` inputs adds: only a tree of one block ends early."""
    return most if block else levels(n)


def address(level: int, index: int, n: int, top: int) -> int:
    """Place of node ``index`` of ``level`` in the postorder of ``n`` leaves and ``top``
    levels: nodes complete before it, from subtree sizes alone."""
    end = min((index + 1) * FAN ** level, n)
    done = sum(-(-end // FAN ** k) for k in range(level + 1))
    return done + sum(index // FAN ** (k - level) for k in range(level + 1, top + 1)) - 1


def append_log(inputs: list[str], top: int) -> list[str]:
    """Nodes over ``inputs`` in the order in which they are complete."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(top + 1)]
    for i, node in enumerate(inputs):
        level, last = 0, i == len(inputs) - 1
        log.append(node)
        waiting[0].append(node)
        while level < top and (last or len(waiting[level]) == FAN):
            node = digest("".join(waiting[level]))
            waiting[level] = []
            level += 1
            log.append(node)
            waiting[level].append(node)
    return log


def siblings(log: list[str], index: int, n: int, top: int) -> list[tuple[str, str]]:
    """Digests to the left and right of input ``index``'s ancestors, level by level."""
    out = []
    for level in range(top):
        own = index // FAN ** level
        first = own // FAN * FAN
        end = min(first + FAN, -(-n // FAN ** level))
        run = [log[address(level, j, n, top)] for j in range(first, end)]
        out.append(("".join(run[:own - first]), "".join(run[own - first + 1:])))
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def leaf_of(docs: DataFrame, text: Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else its bytes, ``:`` and the value."""
    fields = [text if c == "text" else F.col(c).cast("string")
              for c in ("doc_id", "source", "lang", "n_chars", "text")]
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
             for c in fields]
    return F.sha2(F.concat(*parts), 256)


_SEGMENTS = "tree long, block long, inputs array<struct<{0}>>, log array<string>"


def _segments(inputs: DataFrame, more: str = "") -> DataFrame:
    """One row per builder: its inputs in order and the log of its subtree."""
    columns = ["rank", "node", *[c.split()[0] for c in more.split(", ") if c]]
    blocks = inputs.withColumn("block", F.floor(F.col("rank") / BLOCK)).groupBy("tree", "block").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("inputs"))

    def run(batches):
        for batch in batches:
            logs = []
            for block, entries in zip(batch.column(1).to_pylist(), batch.column(2)):
                nodes = entries.values.field("node").to_pylist()
                logs.append(append_log(nodes, height(block, len(nodes), HEIGHT)))
            yield batch.append_column("log", pa.array(logs, pa.list_(pa.string())))

    schema = ", ".join(filter(None, ["rank: bigint, node: string", more.replace(" ", ": ").replace(",:", ",")]))
    return blocks.mapInArrow(run, _SEGMENTS.format(schema))


def build(inputs: DataFrame, more: str = "") -> list[DataFrame]:
    """Tiers of segments over ``inputs(tree, rank, node, ...)``; a tree ends in the first
    tier that has one block of it.  ``more`` names further columns of the inputs."""
    tiers = [persist_shared(_segments(inputs, more), "segments")]
    while True:
        tops = tiers[-1].select("tree", F.col("block").alias("rank"), F.element_at("log", -1).alias("node"))
        going = tops.filter("rank = 1").select("tree")
        if going.isEmpty():
            return tiers
        tiers.append(persist_shared(_segments(tops.join(going, "tree", "left_semi")), "segments"))


def roots(tiers: list[DataFrame]) -> DataFrame:
    """``tree, tier, root`` of every tree."""
    out = None
    for i, tier in enumerate(tiers):
        ended = tier.filter("block = 0")
        if i + 1 < len(tiers):
            ended = ended.join(tiers[i + 1].select("tree"), "tree", "left_anti")
        ended = ended.select("tree", F.lit(i).alias("tier"), F.element_at("log", -1).alias("root"))
        out = ended if out is None else out.unionByName(ended)
    return out


_PATH = ["left", "right", "subroot", "root"]


def _input_paths(segments: DataFrame) -> DataFrame:
    """``tree, rank`` and the path to the root for every input of ``segments``, which
    carry the path of their top."""
    def run(batches):
        for batch in batches:
            for tree, block, nodes, log, left, right, sub, root in zip(
                    *[batch.column(c).to_pylist() for c in ("tree", "block", "n", "log", *_PATH)]):
                top, own = height(block, nodes, HEIGHT), []
                for i in range(nodes):
                    path = siblings(log, i, nodes, top)
                    own.append(([p[0] for p in path] + left, [p[1] for p in path] + right))
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree] * nodes, pa.int64()),
                    "rank": pa.array([block * BLOCK + i for i in range(nodes)], pa.int64()),
                    "left": pa.array([o[0] for o in own], pa.list_(pa.string())),
                    "right": pa.array([o[1] for o in own], pa.list_(pa.string())),
                    "subroot": pa.array([sub] * nodes, pa.string()),
                    "root": pa.array([root] * nodes, pa.string())})

    return segments.select("tree", "block", F.size("inputs").alias("n"), "log", *_PATH).mapInArrow(
        run, "tree long, rank long, left array<string>, right array<string>, subroot string, root string")


def with_paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first tier's segments with the path of their top to the root.

    ``tops(tree, tier, left, right, subroot, root)`` has the path of each tree's own root.
    """
    below = None
    for i in reversed(range(len(tiers))):
        paths = tops.filter(F.col("tier") == i).select("tree", F.lit(0).cast("long").alias("block"), *_PATH)
        if below is not None:
            paths = paths.unionByName(below.withColumnRenamed("rank", "block"))
        segments = tiers[i].join(paths, ["tree", "block"])
        if i:
            below = persist_shared(_input_paths(segments), "paths")
    return segments


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    A leaf digests doc_id, source, lang, n_chars and text; each source's leaves in order
    of doc_id form a tree, whose roots in order of source (null first) form another.
    ``folded_root`` is computed from the row as it would read after tampering (text
    lower-cased where 5 divides the crc32 of the decimal doc_id) and the stored siblings.

    Null fields have a mark of their own; rows without doc_id come first in their source
    and are not tampered with.  Repeated rows are leaves of their own: rows that share a
    doc_id go by leaf, equal ones in any order (their digests are equal, their proofs
    are those of the places they take).  An empty table gives no rows; other columns
    are ignored.
    """
    changed = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & F.col("text").isNotNull()
    leaves = persist_shared(docs.select(
        "doc_id", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), "source")).alias("key"),
        leaf_of(docs, F.col("text")).alias("node"),
        F.when(changed, leaf_of(docs, ascii_lower(F.col("text")))).alias("tampered")), "leaves")
    numbers = persist_shared(ranked(leaves.select("key").distinct(), [], ["key"])
                             .withColumnRenamed("rank", "tree"), "sources")
    inputs = ranked(leaves, ["key"], ["doc_id", "node"]).join(numbers, "key").drop("key")
    tiers = build(inputs, "doc_id bigint, tampered string")

    subroots = persist_shared(roots(tiers), "subroots")
    above = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"),
                                  F.col("root").alias("node")))
    none = F.array().cast("array<string>")
    top = roots(above).select("tree", "tier", none.alias("left"), none.alias("right"),
                              F.lit(None).cast("string").alias("subroot"), "root")
    sources = _input_paths(with_paths(above, top)) \
        .select(F.col("rank").alias("tree"), "left", "right", F.col("root").alias("whole"))
    tops = persist_shared(subroots.join(sources, "tree").select(
        "tree", "tier", "left", "right", F.col("root").alias("subroot"), F.col("whole").alias("root")), "tops")

    def run(batches):
        for batch in batches:
            for block, entries, log, left, right, sub, root in zip(
                    batch.column("block").to_pylist(), batch.column("inputs"),
                    *[batch.column(c).to_pylist() for c in ("log", *_PATH)]):
                ids, nodes, tampered = (entries.values.field(c) for c in ("doc_id", "node", "tampered"))
                n, upper = len(nodes), list(zip(left, right))
                climb, rest = height(block, n, HEIGHT), "".join(x + y for x, y in upper)
                proofs, folded = [], []
                for i, (node, other) in enumerate(zip(nodes.to_pylist(), tampered.to_pylist())):
                    path = siblings(log, i, n, climb)
                    proofs.append(digest("".join(x + y for x, y in path) + rest))
                    folded.append(fold(other or node, path + upper))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids, "leaf": nodes, "subroot": pa.array([sub] * n, pa.string()),
                    "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
                    "folded_root": pa.array(folded, pa.string()),
                    "verified": pa.array([f == root for f in folded], pa.bool_())})

    return with_paths(tiers, tops).mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
             "folded_root string, verified boolean")


def _sql_tree(nodes: str, to: str, depth: int) -> str:
    """CTEs ``{to}0`` to ``{to}{depth}(tree, i, h)``: level by level, single nodes stay."""
    out = [f"{to}0 AS (SELECT tree, i, h FROM {nodes})"]
    for k in range(depth):
        out.append(f"""{to}{k}c AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {to}{k}),
{to}{k + 1} AS (SELECT tree, i // {FAN} AS i, CASE WHEN max(n) = 1 THEN min(h)
   ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {to}{k}c GROUP BY 1, 2)""")
    return ",\n".join(out)


def _sql_proof(start: str, levels_of: str, to: str, depth: int) -> str:
    """CTEs ``{to}0`` to ``{to}{depth}(r, tree, i, proof, h)``: siblings and fold."""
    out = [f"{to}0 AS (SELECT * FROM {start})"]
    for k in range(depth):
        out.append(f"""{to}{k + 1} AS (SELECT p.r, p.tree, p.i // {FAN} AS i,
  p.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> p.i), '') AS proof,
  CASE WHEN max(s.n) = 1 THEN p.h
       ELSE sha256(string_agg(CASE WHEN s.i = p.i THEN p.h ELSE s.h END, '' ORDER BY s.i)) END AS h
  FROM {to}{k} p JOIN {levels_of}{k}c s ON s.tree = p.tree AND s.i // {FAN} = p.i // {FAN}
  GROUP BY p.r, p.tree, p.i, p.proof, p.h)""")
    return ",\n".join(out)


def _sql_leaf(text: str) -> str:
    field = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
    return "sha256(" + " || ".join(field.format(c) for c in (
        "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32, bit by bit: -1 stands for one shift.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
  string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""

#: The same manifest in DuckDB, up to 16 ** 5 documents of a source and 16 ** 3 sources.
MERKLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_sql_leaf('text')} AS leaf,
         CASE WHEN {_CRC} % 5 = 0 THEN {_sql_leaf(_LOWER)} END AS tampered
  FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
      FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT d.*, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
      FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
leaves AS (SELECT tree, i, leaf AS h FROM l),
{_sql_tree('leaves', 'a', 5)},
subroots AS (SELECT 0 AS tree, tree AS i, h FROM a5),
{_sql_tree('subroots', 'b', 3)},
start AS (SELECT r, tree, i, '' AS proof, coalesce(tampered, leaf) AS h FROM l),
{_sql_proof('start', 'a', 'p', 5)},
mid AS (SELECT r, 0 AS tree, tree AS i, proof, h FROM p5),
{_sql_proof('mid', 'b', 'q', 3)}
SELECT l.doc_id, l.leaf, a5.h AS subroot, b3.h AS root, sha256(q3.proof) AS proof_sha256,
       q3.h AS folded_root, q3.h = b3.h AS verified
FROM l JOIN a5 ON a5.tree = l.tree JOIN q3 ON q3.r = l.r CROSS JOIN b3
"""
