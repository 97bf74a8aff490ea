"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that list
them).  A flow routes the patterns' tokens, each usable up to ``repeats`` times at a
convex cost per repetition, to the quotas of their sources.  It says how many tokens
of a pattern each of its sources takes; documents are then chosen in a seeded order by
prefix sums.

Targets come from sorted running sums over the table of sources.  A source that shares
no document with another one needs no search either: its one pattern supplies it.  So
the driver sees only the patterns of sources that overlap, one row each.

The prefix sums need no sort of a whole pattern: a histogram over HASH_BUCKETS
hash ranges finds the range in which a cut falls, and only that range's documents
are put in order.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from cribra.llm.common import n_words, persist_shared, ranked

#: Steps in which the cost of one more pass over a pattern rises.
SLICES = 8
#: The seeded order is a 60-bit hash; its top bits number the histogram's ranges.
HASH_BITS, RANGE_BITS = 60, 12


def code_point_order(sources) -> list:
    """Sources by code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weights: list[int], total: int, repeats: int = 3) -> dict:
    """Tokens per source: ``total`` by weight, at most ``repeats`` times a source's size.

    What a stopped source leaves goes to the others by weight, again and again
    until none is above its limit.  ``weights`` repeat over ``code_point_order``.
    """
    order = code_point_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    limit = {s: repeats * sizes[s] for s in order}
    left, free = total, sum(weight.values())
    level = 0.0
    for s in sorted(order, key=lambda s: limit[s] / weight[s]):
        level = left / free
        if limit[s] >= level * weight[s]:
            break
        left, free = left - limit[s], free - weight[s]
        if not free:
            level = float("inf")
    return {s: float(min(limit[s], level * weight[s])) for s in order}


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = 3) -> dict[tuple, dict]:
    """Min-cost maximum flow from patterns to sources: ``{pattern: {source: tokens}}``.

    Each pass over a pattern can supply its size once; the marginal cost rises by
    1 / SLICES with each slice of a pass.  Only the arcs into patterns cost
    anything, so filling them from the cheapest on, each along augmenting paths as
    far as it goes, is optimal.
    """
    flow = {p: dict.fromkeys(p, 0) for p in patterns}
    members: dict = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)
    room = {s: quotas.get(s, 0) for s in members}

    def augment(start: tuple, amount: int) -> int:
        """Sends up to ``amount`` from ``start`` to a source with room, over the
        shortest path; on the way other patterns may change their source."""
        came: dict = {("p", start): None}
        queue = deque([("p", start)])
        while queue:
            kind, x = node = queue.popleft()
            if kind == "s" and room[x] > 0:
                path = [node]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                back = [(path[i], path[i + 1]) for i in range(len(path) - 1)
                        if path[i][0] == "s"]
                send = min([amount, room[x]] + [flow[p][s] for (_, s), (_, p) in back])
                for (ka, a), (_, b) in zip(path, path[1:]):
                    if ka == "p":
                        flow[a][b] += send
                    else:
                        flow[b][a] -= send
                room[x] -= send
                return send
            if kind == "p":
                step = [("s", s) for s in x]
            else:
                step = [("p", p) for p in members[x] if flow[p][x] > 0]
            for y in step:
                if y not in came:
                    came[y] = node
                    queue.append(y)
        return 0

    order = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    stuck: set = set()
    for level in range(repeats * SLICES):
        part = level % SLICES
        for p in order:
            size = patterns[p]
            left = size * (part + 1) // SLICES - size * part // SLICES
            while left and p not in stuck:
                sent = augment(p, left)
                if not sent:
                    stuck.add(p)  # once cut off from every quota, always cut off
                left -= sent
    return flow


def seeded_hash(doc_id: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))),
                         1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def sized(docs: DataFrame, sources: Column, seed: int = 0) -> DataFrame:
    """``doc_id, sources, size, h`` of every row, written to the shared folder.

    ``sources`` is an array column; repeated names count once, null is a name.
    """
    return persist_shared(
        docs.select(F.col("doc_id"), F.array_sort(F.array_distinct(sources)).alias("sources"),
                    n_words(F.col("text")).alias("size"),
                    seeded_hash(F.col("doc_id"), seed).alias("h")), "sized")


def source_targets(listed: DataFrame, weights: list[int], share: float = 1.0, repeats: int = 3) -> DataFrame:
    """``targets`` over a table: ``source, source_size, target`` from ``listed(source,
    source_size)``; ``share`` of all sizes is shared out.

    Sources are numbered by code point, null last, and ordered by the level at which
    they stop; the first that does not stop gives the level of the rest.
    """
    order = ranked(listed.withColumn("last", F.col("source").isNull()), [], ["last", "source"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * repeats
    order = order.select("source", "source_size", F.col("rank").alias("place"), weight.cast("long").alias("w"),
                         cap.alias("cap"), (cap.cast("double") / weight).alias("stops"))
    order = persist_shared(ranked(order, [], ["stops", "place"], ("cap", "w")), "targets")
    total = order.agg(F.sum("source_size"), F.sum("w")).first()
    tokens = int(share * (total[0] or 0))
    level = (F.lit(tokens) - F.col("cap_before")).cast("double") / (F.lit(total[1] or 0) - F.col("w_before"))
    first = order.withColumn("level", level).filter("cap >= level * w") \
        .agg(F.min_by("level", "rank").alias("level")).first()["level"]
    target = F.col("cap").cast("double") if first is None else \
        F.least(F.col("cap").cast("double"), F.lit(first) * F.col("w"))
    return order.select("source", "source_size", target.alias("target"))


def pattern_sizes(docs: DataFrame) -> DataFrame:
    """``sources, size``: tokens per membership pattern, without the empty one."""
    return docs.groupBy("sources").agg(F.sum("size").alias("size")).filter("size(sources) > 0")


def _shared(patterns: DataFrame, max_patterns: int) -> dict[tuple, int]:
    """The patterns of all sources that share a document with another one; raises
    beyond ``max_patterns``, the bound on the flow that the driver solves."""
    touched = patterns.filter("size(sources) > 1").select(F.explode("sources").alias("s")).distinct() \
        .select(F.array("s").alias("sources"))
    rows = patterns.filter("size(sources) > 1").unionByName(
        patterns.join(touched, "sources", "left_semi")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} overlapping membership patterns: group the sources first")
    return {tuple(r["sources"]): r["size"] for r in rows}


_CUTS = T.StructType([
    T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("i", T.IntegerType()),
    T.StructField("source", T.StringType()), T.StructField("passes", T.LongType()),
    T.StructField("cut", T.LongType())])


def cuts(patterns: DataFrame, goal: DataFrame, repeats: int = 3, max_patterns: int = 100_000) -> DataFrame:
    """``sources, i, source, passes, cut``: where the stretch of each source of a pattern
    ends, in whole passes over the pattern and tokens of the next one."""
    quota = F.floor(F.col("target") + 0.5).cast("long")
    shared = _shared(patterns, max_patterns)
    rows, names = [], sorted({s for p in shared for s in p}, key=lambda s: (s is None, s or ""))
    if shared:
        wanted = goal.sparkSession.createDataFrame([(s,) for s in names], "s string")
        found = goal.join(wanted, goal["source"].eqNullSafe(wanted["s"])).select("source", quota.alias("q"))
        flow = route(shared, {r["source"]: r["q"] for r in found.collect()}, repeats)
        for p, parts in flow.items():
            end = 0
            for i, s in enumerate(p):
                end += parts[s]
                if shared[p]:
                    rows.append((list(p), i, s, end // shared[p], end % shared[p]))
    solved = goal.sparkSession.createDataFrame(rows, _CUTS)
    taken = F.least(quota, F.col("source_size") * repeats)
    alone = goal.withColumn("sources", F.array("source")).join(
        goal.sparkSession.createDataFrame([([s],) for s in names], "sources array<string>"), "sources", "left_anti")
    div = lambda name: F.call_function(name, taken, F.col("source_size"))
    return solved.unionByName(alone.filter("source_size > 0").select(
        "sources", F.lit(0).alias("i"), "source", div("div").alias("passes"), div("mod").alias("cut")))


def _marks(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """``sources, marks``: the last document of each stretch, from ``sized`` documents
    and ``cuts``."""
    shift = HASH_BITS - RANGE_BITS
    docs = docs.withColumn("range", F.shiftright("h", shift))
    hist = docs.groupBy("sources", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("sources").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("start", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    hit = hist.join(ends, "sources").filter("start < cut AND cut <= start + in_range") \
              .select("sources", "range", "i", "start", "cut")
    line = docs.join(hit.select("sources", "range").distinct(), ["sources", "range"], "left_semi") \
               .groupBy("sources", "range", "h", "doc_id").agg(F.sum("size").alias("size"))
    up_to = Window.partitionBy("sources", "range").orderBy("h", "doc_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("end", F.sum("size").over(up_to))
    # a document lies before the cut if twice its middle is below twice the cut
    last = hit.join(line, ["sources", "range"], "left") \
              .filter("doc_id IS NULL OR 2 * (start + end) - size < 2 * cut") \
              .groupBy("sources", "i").agg(F.max(F.struct("h", "doc_id")).alias("last"))
    found = hit.join(last, ["sources", "i"], "left").select("sources", "i", "range", "last")
    return ends.join(found, ["sources", "i"], "left").groupBy("sources").agg(
        F.array_sort(F.collect_list(F.struct("i", "source", "passes", "range", "last"))).alias("marks"))


def _passes(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds ``n``: per source of a document's pattern, how often the stretches up to that
    source's take the document (doc_id, sources, size, h)."""
    me = F.struct("h", "doc_id")
    return docs.withColumn("range", F.shiftright("h", HASH_BITS - RANGE_BITS)) \
        .join(marks, "sources", "left").withColumn("n", F.transform(
            "marks", lambda m: F.when(F.col("size") == 0, 0).otherwise(m["passes"] + F.when(
                (F.col("range") < m["range"])
                | ((F.col("range") == m["range"]) & (me <= m["last"])), 1).otherwise(0))))


def _copies() -> Column:
    return F.coalesce(F.get("n", F.size("n") - 1), F.lit(0)).cast("long")


def _solved(docs: DataFrame, sources: Column, weights: list[int], share: float, repeats: int,
            seed: int, max_patterns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents, targets, and the marks of the mix."""
    table = sized(docs, sources, seed)
    patterns = persist_shared(pattern_sizes(table), "patterns")
    listed = patterns.select(F.explode("sources").alias("source"), "size") \
        .groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = persist_shared(source_targets(listed, weights, share, repeats), "goal")
    ends = persist_shared(cuts(patterns, goal, repeats, max_patterns), "cuts")
    return table, goal, persist_shared(_marks(table, ends), "marks")


def mix(docs: DataFrame, sources: Column, weights: list[int], share: float = 1.0,
        repeats: int = 3, seed: int = 0, max_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Chooses documents so that each source comes near its share of the tokens.

    ``docs`` needs doc_id and text; ``sources`` is an array column of the sources
    that list a document.  Returns the choice, ``doc_id, sources, size, copies,
    by_source``, and ``source, source_size, target`` of each source: the tokens that it
    lists and those it should get, of ``share`` of all that sources list.

    ``copies`` is how often the mix takes the document, ``by_source`` how many of them
    each source counts.  Within a pattern the documents form a line in seeded order,
    passed over again and again; each source takes a stretch of it.  A document belongs
    to the stretch its middle lies in, so each stretch is met to half a document.  Rows
    of one doc_id and pattern go together.  Documents without sources or words are taken
    0 times.  Null texts have size 0; an empty table gives an empty choice.  Reruns
    choose the same documents.  More than ``max_patterns`` patterns of overlapping
    sources raise ValueError; sources of their own may be any number.
    """
    table, goal, marks = _solved(docs, sources, weights, share, repeats, seed, max_patterns)
    return _passes(table, marks).select(
        "doc_id", "sources", "size", _copies().alias("copies"),
        F.transform("marks", lambda m, i: F.struct(
            m["source"].alias("source"),
            (F.get("n", i) - F.coalesce(F.get("n", i - 1), F.lit(0))).alias("copies"))).alias("by_source")), goal


def mix_by_source(docs: DataFrame, weights: list[int], seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` with each document's one source.

    ``taken`` counts words, repeats included.  See ``mix`` for empty cases.
    """
    chosen, goal = mix(docs, F.array("source"), weights, seed=seed)
    per_source = goal.select(F.array("source").alias("sources"), "source_size", "target")
    return chosen.join(per_source, "sources", "left").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))


def repeat_documents(docs: DataFrame, weights: list[int], seed: int = 0) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it.

    All columns stay; rows that the mix takes 0 times go.  A doc_id that stands in
    several sources is taken by each as its own targets say.
    """
    one = F.array("source")
    _, _, marks = _solved(docs, one, weights, 1.0, 3, seed, 1)
    rows = docs.select(F.struct("*").alias("whole"), "doc_id", one.alias("sources"),
                       n_words(F.col("text")).alias("size"), seeded_hash(F.col("doc_id"), seed).alias("h"))
    return _passes(rows, marks).select("whole", _copies().alias("copies")).filter("copies > 0") \
        .select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


#: The same mix of single-source documents in DuckDB, for weights 5, 2, 1 and seed 0.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
k AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS nr
  FROM s
  WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(min_by(level, nr) FILTER (cap >= level * w), 'inf'::DOUBLE) AS level FROM k),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, l.level * w) AS target,
         least(floor(least(cap::DOUBLE, l.level * w) + 0.5)::BIGINT, cap) AS quota
  FROM k, l),
p AS (
  SELECT d.doc_id, d.size, d.h, t.source_size, t.target, t.quota,
         2 * sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id) - d.size AS mid2
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size
         + CASE WHEN mid2 < 2 * (quota % source_size) THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM p
"""
