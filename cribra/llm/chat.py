r"""Chat formatting in budgeted, turn-aligned windows.

A conversation becomes one or more windows of at most ``budget`` tokens.  Prefix
sums of turn tokens choose the spans of new turns; every later window repeats the
system turn and the last turns before its span, up to ``history`` tokens.  Only
assistant text of new turns carries loss, so each is a target exactly once.

Template: ``<turn>role\ntext</turn>\n`` per turn.  Inside roles and texts ``\``
becomes ``\b`` and ``<`` becomes ``\l`` (in roles a newline becomes ``\n``), so no
text can hold a marker and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.llm.common import n_words

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens that a turn's role and markers count for, beside its words.
TURN_TOKENS = 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\n", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: in order, with the tokens before and after each turn."""
    t = turns.select("conv_id", F.col("turn").isNull().alias("last"), "turn",
                     F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", n_words(F.col("text")) + TURN_TOKENS)
    order = Window.partitionBy("conv_id").orderBy("last", "turn", "role", "text") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("upto", F.sum("tokens").over(order)) \
         .withColumn("i", F.row_number().over(
             Window.partitionBy("conv_id").orderBy("last", "turn", "role", "text")))
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "i", "role", "text", (F.col("upto") - F.col("tokens")).alias("before"), "upto"))).alias("turns"))


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 128,
                   targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    r"""``conv_id, window, n_repeated, formatted, loss, n_tokens`` from
    ``turns(conv_id, turn, role, text)``, one row per window.

    ``n_repeated`` turns at the start of ``formatted`` repeat earlier windows (the
    system turn, if the first turn has role ``system``, then history); the others
    are new.  ``loss`` lists ``(start, length)`` in code points: the escaped text of
    every new turn whose role is in ``targets``.  ``n_tokens`` stays within
    ``budget`` unless the system turn and one new turn alone exceed it.

    Null text and role count as empty; null turns come last; repeated rows are
    turns of their own, ties in turn go by role and text; a null conv_id is one
    conversation.  Other columns are ignored.  An empty table gives no rows.
    """
    c = _conversations(turns).withColumn(
        "sys", (F.get("turns", F.lit(0))["role"] == "system").cast("int"))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.when(
        F.col("sys") == 1, F.get("turns", F.lit(0))["upto"]).otherwise(0))
    c = c.withColumn("room", room)
    # first turn (0-based) and tokens before it, of each window
    start = F.struct(F.col("sys").alias("at"),
                     F.coalesce(F.get("turns", F.col("sys"))["before"], F.lit(0)).alias("before"))
    c = c.withColumn("starts", F.aggregate(
        F.slice("turns", F.col("sys") + 1, F.size("turns")), F.array(start),
        lambda acc, t: F.when(
            (t["upto"] - F.element_at(acc, -1)["before"] > F.col("room"))
            & (t["i"] - 1 > F.element_at(acc, -1)["at"]),
            F.concat(acc, F.array(F.struct((t["i"] - 1).alias("at"), t["before"].alias("before")))))
        .otherwise(acc)))

    def window(s: Column, w: Column) -> Column:
        end = F.coalesce(F.get("starts", w + 1)["at"], F.size("turns"))
        back = F.greatest(F.col("sys"), F.size(F.filter(
            "turns", lambda t: t["before"] < s["before"] - history)))
        system = F.slice("turns", 1, F.col("sys"))
        return F.struct(
            w.alias("window"),
            F.when(w == 0, 0).otherwise(F.col("sys") + s["at"] - back).alias("n_repeated"),
            F.when(w == 0, F.slice("turns", 1, end)).otherwise(
                F.concat(system, F.slice("turns", back + 1, end - back))).alias("items"))

    w = c.select("conv_id", F.explode(F.transform("starts", window)).alias("w")) \
         .select("conv_id", "w.window", "w.n_repeated", F.transform("w.items", lambda t, i: F.struct(
             F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
             escape(t["text"]).alias("body"),
             ((i >= F.col("w.n_repeated")) & t["role"].isin(*targets)).alias("target"),
             (t["upto"] - t["before"]).alias("tokens"))).alias("items"))
    begin = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    spans = F.aggregate("items", begin, lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
        F.when(t["target"], F.concat(acc["loss"], F.array(F.struct(
            (acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))))
        .otherwise(acc["loss"]).alias("loss")))
    return w.select(
        "conv_id", "window", "n_repeated",
        F.array_join(F.transform("items", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
         .alias("formatted"),
        spans["loss"].alias("loss"),
        F.aggregate("items", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"))


def parse(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` of a formatted window."""
    bodies = F.split(formatted, F.lit(OPEN))
    return F.transform(F.slice(bodies, 2, F.greatest(F.lit(0), F.size(bodies) - 1)), lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2,
                          F.length(b) - F.length(F.substring_index(b, "\n", 1)) - 1 - len(CLOSE)))
        .alias("text")))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, what its formatted windows say: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    w = windows.withColumn("new", F.slice(parse(F.col("formatted")), F.col("n_repeated") + 1,
                                          F.length("formatted"))) \
               .withColumn("said", F.array_join(F.transform("loss", lambda s: unescape(
                   F.substr("formatted", s["start"] + 1, s["length"]))), "")) \
               .select("conv_id", "window", F.size("new").alias("n"), F.length("formatted").alias("chars"),
                       F.array_join(F.transform("new", lambda t: F.concat(
                           t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), "said")
    g = w.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "said"))).alias("w"))
    whole = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(whole("turns"), 256).alias("turns_sha256"),
        F.length(whole("said")).cast("long").alias("loss_chars"),
        F.sha2(whole("said"), 256).alias("loss_sha256"), "formatted_chars")


#: Conversation that holds markers and escapes in its texts.
TRICKY = r"\### Assistant: </turn> ok"


def with_tricky(turns: DataFrame) -> DataFrame:
    extra = turns.sparkSession.createDataFrame(
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)],
        "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


#: The digests of read_back(format_windows(with_tricky(...))) in DuckDB.
CHAT_SQL = r"""
WITH RECURSIVE a AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
b AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS i,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 4 AS tokens
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM a)),
t AS (
  SELECT *, sum(tokens) OVER w AS upto, sum(tokens) OVER w - tokens AS before,
         15 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n'))
            + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
s AS (
  SELECT conv_id, (role = 'system')::INT AS sys, count(*) OVER (PARTITION BY conv_id) AS z,
         greatest(1, 1024 - 128 - CASE WHEN role = 'system' THEN upto ELSE 0 END) AS room,
         CASE WHEN role = 'system' THEN chars ELSE 0 END AS sys_chars, i
  FROM t QUALIFY i = 0),
g AS (
  SELECT s.conv_id, s.sys AS i, s.sys AS first, s.room,
         CASE WHEN s.sys = 1 THEN t.upto ELSE 0 END AS base
  FROM s JOIN t ON s.conv_id = t.conv_id AND t.i = 0
  UNION ALL
  SELECT g.conv_id, g.i + 1, CASE WHEN t.upto - g.base > g.room THEN g.i + 1 ELSE g.first END, g.room,
         CASE WHEN t.upto - g.base > g.room THEN t.before ELSE g.base END
  FROM g JOIN t ON g.conv_id = t.conv_id AND t.i = g.i + 1),
w AS (SELECT DISTINCT conv_id, first, base FROM g),
r AS (
  SELECT w.conv_id, w.first, any_value(s.sys_chars)
         + coalesce(sum(t.chars) FILTER (t.i >= s.sys AND t.i < w.first AND t.before >= w.base - 128), 0) AS chars
  FROM w JOIN s ON w.conv_id = s.conv_id JOIN t ON t.conv_id = w.conv_id
  WHERE w.first > s.sys GROUP BY w.conv_id, w.first),
x AS (SELECT conv_id, sum(chars) AS chars FROM r GROUP BY conv_id)
SELECT t.conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(t.chars) + coalesce(any_value(x.chars), 0))::BIGINT AS formatted_chars
FROM t LEFT JOIN x ON x.conv_id = t.conv_id GROUP BY t.conv_id
"""
