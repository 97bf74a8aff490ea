"""Operator configurations on the driver's tables, each with a DuckDB oracle.

Every query reads whole tables (parquet, column-pruned by Catalyst) and
returns a DataFrame; ``ORACLE[name]`` is an independently written SQL statement
that DuckDB runs on the same files.  Column names and types match between the
two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribra.functions import formula as fm
from cribra.functions import labels as lb
from cribra.functions import text as tx
from cribra.operators import parse as ps
from cribra.operators import rules as rl
from cribra.operators import select as sl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Whitespace class for the DuckDB side (RE2 syntax, same code points as Spark's).
W = tx.WS_CLASS


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def _sql_norm(x: str) -> str:
    return f"regexp_replace({_sql_strip(x)}, '{W}+', ' ', 'g')"


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- F1 F2 F10

@register("normalize_text", f"""
SELECT doc_id,
       {_sql_strip('text')} AS stripped,
       {_sql_norm('text')} AS normalized,
       CAST(length(regexp_replace(text, '{W}+', '', 'g')) AS INTEGER) AS n_nonblank
FROM documents""")
def q_normalize_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.strip_ws("text").alias("stripped"),
                    tx.normalize_ws("text").alias("normalized"),
                    F.length(tx.remove_ws("text")).alias("n_nonblank"))


# --------------------------------------------------------------- D1 W1 W2

DOC_CAP = 3


def _docs_ranked(spark, sf, cap):
    """D1 + W1 (+ W2): only hashes of the normalised texts are shuffled; the texts
    are fetched for the documents that stay."""
    d = table(spark, sf, "documents")
    k = tx.normalize_ws("text")
    keys = d.filter(k != "").select("doc_id", "source", F.sha2(k, 256).alias("k"))
    keys = sl.dedupe_first(keys, "source", "k", "doc_id")
    # without a cap a source may be of any size
    keys = sl.number_large(keys, ["source"], ["doc_id"]) if cap is None else \
        sl.number_rows(keys, "source", "doc_id", "rank", limit=cap)
    keys = keys.select("doc_id", "rank")
    return d.join(keys, "doc_id").select("doc_id", "source", tx.strip_ws("text").alias("text"), "rank")


def _sql_docs_ranked(cap: int | None) -> str:
    last = "" if cap is None else f" WHERE rank < {cap}"
    return f"""
WITH n AS (SELECT doc_id, source, {_sql_strip('text')} AS text, {_sql_norm('text')} AS k
           FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id) AS rn
      FROM n WHERE k <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank
      FROM d WHERE rn = 1)
SELECT * FROM r{last}"""


@register("dedupe_cap", f"""
{_sql_docs_ranked(DOC_CAP)}""".replace("SELECT * FROM r WHERE", "SELECT source, CAST(rank AS INTEGER) AS rank, doc_id, text FROM r WHERE"))
def q_dedupe_cap(spark, sf):
    return _docs_ranked(spark, sf, DOC_CAP).select("source", "rank", "doc_id", "text")


LONG_LINE = 60


def _long_line_key(c) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda line: F.length(line) >= LONG_LINE)
    return tx.normalize_ws(F.array_join(lines, "\n"))


@register("dedupe_keep_blank", f"""
WITH base AS ({_sql_docs_ranked(None)}),
k AS (SELECT source, rank, doc_id,
             {_sql_norm(f"array_to_string(list_filter(string_split(text, chr(10)), lambda l: length(l) >= {LONG_LINE}), chr(10))")} AS fk
      FROM base),
d2 AS (SELECT *, row_number() OVER (PARTITION BY source, fk ORDER BY rank) AS rn2 FROM k)
SELECT source, CAST(rank AS INTEGER) AS rank, doc_id, fk = '' AS blank_key
FROM d2 WHERE fk = '' OR rn2 = 1""")
def q_dedupe_keep_blank(spark, sf):
    r = _docs_ranked(spark, sf, None).withColumn("fk", _long_line_key(F.col("text")))
    r = r.select("source", F.col("rank").cast("int").alias("rank"), "doc_id",
                 F.when(F.col("fk") == "", "").otherwise(F.sha2("fk", 256)).alias("fk"))
    out = sl.dedupe_first(r, "source", "fk", "rank", keep_blank=True)
    return out.select("source", "rank", "doc_id", (F.col("fk") == "").alias("blank_key"))


# --------------------------------------------------------------- W4 W5

@register("best_of_orders", """
SELECT o_custkey, o_orderkey FROM (
  SELECT o_custkey, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY
            (o_orderstatus = 'F') DESC, floor(o_totalprice / 50000) DESC,
            CAST(substr(o_orderpriority, 1, 1) AS INTEGER) ASC,
            (o_orderstatus <> 'P') DESC, o_orderkey ASC) AS order_no
  FROM orders) WHERE order_no = 1""")
def q_best_of_orders(spark, sf):
    o = table(spark, sf, "orders")
    keys = [(F.col("o_orderstatus") == "F").desc(),
            F.floor(F.col("o_totalprice") / 50000).desc(),
            F.substring("o_orderpriority", 1, 1).cast("int").asc(),
            (F.col("o_orderstatus") != "P").desc(),
            F.col("o_orderkey").asc()]
    return sl.best_per_group(o, "o_custkey", keys).select("o_custkey", "o_orderkey")


# --------------------------------------------------------------- A5

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _line_candidates(spark, sf):
    li = table(spark, sf, "lineitem")
    cand = sl.number_rows(li, "l_orderkey", LINE_ORDER, "rank")
    keys = [(F.col("l_returnflag") == "N").desc(), F.col("l_quantity").desc(),
            F.col("l_discount").asc(), (F.col("l_linestatus") == "F").desc(),
            F.col("rank").asc()]
    return sl.rank_candidates(cand, "l_orderkey", keys)


_SQL_LINE_CAND = f"""
cand AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
           {', '.join(LINE_ORDER)}) - 1 AS rank FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
             (l_returnflag = 'N') DESC, l_quantity DESC, l_discount ASC,
             (l_linestatus = 'F') DESC, rank ASC) AS order_no FROM cand)"""


@register("all_and_best", f"""
WITH {_SQL_LINE_CAND}
SELECT l_orderkey,
       CAST(max(CASE WHEN order_no = 1 THEN l_linenumber END) AS INTEGER) AS best_line,
       string_agg(CAST(rank AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':'
                  || CAST(l_partkey AS VARCHAR), ',' ORDER BY order_no) AS all_lines,
       count(*) AS n_candidates
FROM ranked GROUP BY l_orderkey""")
def q_all_and_best(spark, sf):
    ranked = _line_candidates(spark, sf)
    lists = sl.collect_ranked(ranked, "l_orderkey", "order_no",
                              ["rank", "l_linenumber", "l_partkey"])
    return lists.select(
        "l_orderkey",
        F.col("all")[0]["l_linenumber"].alias("best_line"),
        F.array_join(F.transform("all", lambda x: F.concat_ws(
            ":", x["rank"].cast("string"), x["l_linenumber"].cast("string"),
            x["l_partkey"].cast("string"))), ",").alias("all_lines"),
        F.size("all").cast("bigint").alias("n_candidates"))


# --------------------------------------------------------------- W3 W6

@register("rank_scaffold", f"""
SELECT source, lang, CAST(order_no AS INTEGER) AS order_no, doc_id FROM (
  SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY
           (n_chars < 2000) DESC, len(string_split(text, chr(10))) ASC, (lang = 'en') DESC,
           length(text) DESC, doc_id ASC) AS order_no
  FROM documents) WHERE order_no <= 2""")
def q_rank_scaffold(spark, sf):
    d = table(spark, sf, "documents")
    keys = [(F.col("n_chars") < 2000).desc(), F.size(F.split("text", "\n")).asc(),
            (F.col("lang") == "en").desc(), F.length("text").desc(), F.col("doc_id").asc()]
    return sl.rank_candidates(d, ["source", "lang"], keys, limit=2) \
             .select("source", "lang", "order_no", "doc_id")


# --------------------------------------------------------------- F3 F4 P7

@register("tagged_block", f"""
WITH s AS (SELECT page_id, {_sql_strip('html')} AS v FROM pages),
p AS (SELECT page_id, v, strpos(v, '<title>') AS b, strpos(v, '</title>') AS e FROM s),
q AS (SELECT *, CASE WHEN b > 0 THEN strpos(substr(v, b), '</title>') ELSE 0 END AS rel FROM p)
SELECT page_id,
       CASE WHEN b = 0 OR e = 0 THEN v
            WHEN rel > 0 THEN {_sql_strip("substr(v, b, rel - 1 + 8)")} END AS block,
       CASE WHEN b > 0 AND e > 0 AND rel = 0 THEN 'bad_tag_order' END AS block_error
FROM q""")
def q_tagged_block(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.tagged_block("html", "<title>", "</title>").alias("block"),
                    tx.tagged_block_error("html", "<title>", "</title>").alias("block_error"))


_CUT_DROP = ("<!DOCTYPE html>", "</html>")


@register("cut_marker", f"""
WITH s AS (SELECT page_id,
  {_sql_strip(f"replace(replace({_sql_strip('html')}, '{_CUT_DROP[0]}', ''), '{_CUT_DROP[1]}', '')")} AS v
  FROM pages)
SELECT page_id, {_sql_strip("CASE WHEN strpos(v, '<body') > 0 THEN substr(v, strpos(v, '<body')) ELSE v END")} AS cut
FROM s""")
def q_cut_marker(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.cut_from_marker("html", "<body", _CUT_DROP).alias("cut"))


_DEG_ANY = ("MIT License", "Apache License", "@")
_DEG_ALL = ("\n", " the ", " and ")


@register("degenerate", f"""
SELECT doc_id,
  (contains(text, 'MIT License') OR contains(text, 'Apache License') OR contains(text, '@'))
  OR (contains(text, chr(10)) AND contains(text, ' the ') AND contains(text, ' and '))
  AS degenerate
FROM documents""")
def q_degenerate(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", ps.degenerate("text", _DEG_ANY, _DEG_ALL).alias("degenerate"))


# --------------------------------------------------------------- F8 + S6 table form

@register("safe_stem", f"""
WITH s AS (SELECT p_partkey,
  CASE WHEN t = '' THEN 'sample' ELSE t END AS stem FROM (
    SELECT p_partkey, trim(regexp_replace({_sql_strip("p_name || ' / ' || p_brand || '.'")},
                                          '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS t
    FROM part))
SELECT p_partkey, stem, count(*) OVER (PARTITION BY stem) AS n_same_stem,
       p_partkey = max(p_partkey) OVER (PARTITION BY stem) AS kept
FROM s""")
def q_safe_stem(spark, sf):
    from cribra.sources.io import stem_collisions
    p = table(spark, sf, "part").select(
        "p_partkey", tx.safe_stem(F.concat_ws("", "p_name", F.lit(" / "), "p_brand",
                                              F.lit("."))).alias("stem"))
    return stem_collisions(p, "stem", "p_partkey").select(
        "p_partkey", "stem", "n_same_stem", "kept")


# --------------------------------------------------------------- F9

def _part_fields(p: DataFrame) -> Column:
    """A scaffold-like field map built from part columns, with absent and empty
    entries on purpose."""
    k = F.col("p_partkey")
    vals = {
        "reduced_ratio": F.col("p_brand"),
        "condition_sg_number": F.col("p_size").cast("string"),
        "output_Z_raw": F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 4).cast("string"))
                         .otherwise(F.lit("")),
        "n_listed_sites": F.when(k % 3 != 0, (k % 9).cast("string")),
        "metric_family": F.col("p_type"),
        "position_family": F.substring_index("p_name", " ", 1),
        "stack_family": F.lit(""),
        "prototype_bucket_v4": F.col("p_name"),
    }
    m = F.create_map(*[x for kk, v in vals.items() for x in (F.lit(kk), v)])
    return F.map_filter(m, lambda _k, v: v.isNotNull())


@register("ladder_keys", """
SELECT p_partkey, p_name AS key1,
  concat_ws('|', p_brand, CAST(p_size AS VARCHAR),
            'z' || CASE WHEN p_size % 4 <> 0 THEN CAST(p_size % 4 AS VARCHAR) ELSE '' END,
            'n' || CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 9 AS VARCHAR) ELSE '' END,
            p_type, split_part(p_name, ' ', 1), '') AS key2,
  concat_ws('|', p_brand, CAST(p_size AS VARCHAR),
            'z' || CASE WHEN p_size % 4 <> 0 THEN CAST(p_size % 4 AS VARCHAR) ELSE '' END,
            'n' || CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 9 AS VARCHAR) ELSE '' END) AS key3
FROM part""")
def q_ladder_keys(spark, sf):
    from cribra.operators.lookup import ladder_keys
    p = table(spark, sf, "part")
    keys = ladder_keys(_part_fields(p))
    return p.select("p_partkey", keys[0]["key"].alias("key1"), keys[1]["key"].alias("key2"),
                    keys[2]["key"].alias("key3"))


# --------------------------------------------------------------- F5 F6 F20

MAX_LEN, MAX_NEW = 1536, 192


def _sql_prompt() -> str:
    head, rest = tx.PROMPT_TEMPLATE.split("{instruction}")
    mid, rest = rest.split("{input_text}")
    tail_a, tail_b = rest.split("{response}")
    instr = _sql_strip("'Reply as ' || role")
    body = _sql_strip(f"concat_ws('\n\n', text, {_sql_strip('role')})")
    return (f"{_sql_lit(head)} || {instr} || {_sql_lit(mid)} || {body} || "
            f"{_sql_lit(tail_a)} || '' || {_sql_lit(tail_b)}")


@register("render_prompt", f"""
WITH p AS (SELECT conv_id, turn, {_sql_prompt()} AS prompt FROM conversations)
SELECT conv_id, turn, prompt,
  CASE WHEN {MAX_LEN} - length(prompt) - 16 > 0
       THEN CAST(least({MAX_NEW}, {MAX_LEN} - length(prompt) - 16) AS INTEGER) END AS budget,
  CASE WHEN {MAX_LEN} - length(prompt) - 16 <= 0 THEN 'prompt_too_long' END AS budget_error
FROM p""")
def q_render_prompt(spark, sf):
    c = table(spark, sf, "conversations")
    prompt = tx.render_prompt(F.concat(F.lit("Reply as "), "role"), tx.prompt_body("text", "role"))
    out = c.select("conv_id", "turn", prompt.alias("prompt"))
    n = F.length("prompt")
    return out.select("conv_id", "turn", "prompt",
                      tx.token_budget(n, F.lit(MAX_LEN), F.lit(MAX_NEW)).alias("budget"),
                      tx.token_budget_error(n, F.lit(MAX_LEN)).alias("budget_error"))


# --------------------------------------------------------------- F17 F18

@register("json_list", """
SELECT o_orderkey,
  '["' || o_orderstatus || '", "' || o_orderpriority || '", "say \\"' || o_orderstatus
     || '\\""]' AS as_json,
  CASE WHEN o_totalprice > 200000 THEN 'True' ELSE 'False' END AS big,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status_text
FROM orders""")
def q_json_list(spark, sf):
    o = table(spark, sf, "orders")
    arr = F.array("o_orderstatus", "o_orderpriority",
                  F.concat(F.lit('say "'), "o_orderstatus", F.lit('"')))
    return o.select("o_orderkey", tx.json_list(arr).alias("as_json"),
                    tx.bool_text(F.col("o_totalprice") > 200000).alias("big"),
                    tx.text_or_empty(F.when(F.col("o_orderstatus") != "P",
                                            F.col("o_orderstatus"))).alias("status_text"))


# --------------------------------------------------------------- P2 J2

def _sql_system(x: str) -> str:
    parts = []
    lo = 0
    for hi, label in lb.CRYSTAL_SYSTEMS:
        parts.append(f"WHEN {x} BETWEEN {lo + 1} AND {hi} THEN '{label}'")
        lo = hi
    return "CASE " + " ".join(parts) + " END"


@register("code_range", f"""
WITH t AS (SELECT o_orderkey, o_orderkey % 240 AS v, o_orderkey % 6 AS form FROM orders)
SELECT o_orderkey,
  CASE form WHEN 0 THEN CAST(v AS VARCHAR) || '.9' WHEN 1 THEN ' ' || CAST(v AS VARCHAR) || ' '
            WHEN 2 THEN CAST(v AS VARCHAR) || 'e0' WHEN 3 THEN 'x' || CAST(v AS VARCHAR)
            WHEN 4 THEN CAST(v AS VARCHAR) || 'd' ELSE CAST(v AS VARCHAR) END AS code_text,
  CASE WHEN form IN (3, 4) THEN NULL WHEN v BETWEEN 1 AND 230 THEN CAST(v AS INTEGER) END AS code,
  CASE WHEN form IN (3, 4) THEN NULL ELSE {_sql_system('v')} END AS system
FROM t""")
def q_code_range(spark, sf):
    o = table(spark, sf, "orders")
    v = (F.col("o_orderkey") % 240).cast("string")
    form = F.col("o_orderkey") % 6
    txt = (F.when(form == 0, F.concat(v, F.lit(".9")))
            .when(form == 1, F.concat(F.lit(" "), v, F.lit(" ")))
            .when(form == 2, F.concat(v, F.lit("e0")))
            .when(form == 3, F.concat(F.lit("x"), v))
            .when(form == 4, F.concat(v, F.lit("d")))
            .otherwise(v))
    out = o.select("o_orderkey", txt.alias("code_text"))
    code = rl.parse_code("code_text")
    return out.select("o_orderkey", "code_text", code.alias("code"),
                      lb.crystal_system(code).alias("system"))


# --------------------------------------------------------------- F14 F15 F16

_DISC_EDGES = (0.02, 0.05, 0.08)
_RATIO_EDGES = (0.1, 0.5, 1.0, 2.0)


def _sql_bin(x: str, edges, prefix: str) -> str:
    idx = " + ".join(f"CASE WHEN {float(e)!r} <= {x} THEN 1 ELSE 0 END" for e in edges)
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL ELSE '{prefix}' || CAST(({idx}) AS VARCHAR) END"


_SQL_PATTERN = """CASE WHEN abs(a - b) <= 0.01 AND abs(a - c) <= 0.01 AND abs(b - c) <= 0.01 THEN 'ALL_EQ'
     WHEN abs(a - b) <= 0.01 THEN 'A_EQ_B_NE_C' WHEN abs(a - c) <= 0.01 THEN 'A_EQ_C_NE_B'
     WHEN abs(b - c) <= 0.01 THEN 'B_EQ_C_NE_A' ELSE 'ALL_DIFF' END"""


@register("bins_patterns", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_discount, l_quantity AS a, l_tax * 100 AS b,
                  l_discount * 100 AS c FROM lineitem),
p AS (SELECT *, {_SQL_PATTERN} AS pattern FROM t)
SELECT l_orderkey, l_linenumber, pattern,
       {_sql_bin('l_discount', _DISC_EDGES, 'D')} AS discount_bin,
       CASE WHEN pattern = 'ALL_DIFF' THEN {_sql_bin('(b / greatest(a, 1e-8))', _RATIO_EDGES, 'R')}
            ELSE '' END AS ratio_bin
FROM p""")
def q_bins_patterns(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", F.col("l_quantity").alias("a"),
        (F.col("l_tax") * 100).alias("b"), (F.col("l_discount") * 100).alias("c"))
    pat = lb.equal_pattern("a", "b", "c", 0.01)
    out = li.withColumn("pattern", pat)
    return out.select("l_orderkey", "l_linenumber", "pattern",
                      lb.bin_label("l_discount", _DISC_EDGES, prefix="D").alias("discount_bin"),
                      lb.ratio_bin_if("pattern", "b", "a", _RATIO_EDGES, prefix="R")
                      .alias("ratio_bin"))


# --------------------------------------------------------------- A1

@register("count_schema", """
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS p
           FROM lineitem GROUP BY l_orderkey, l_returnflag)
SELECT l_orderkey, string_agg(l_returnflag || ':' || CAST(n AS VARCHAR), '|'
                              ORDER BY p, l_returnflag) AS schema
FROM c GROUP BY l_orderkey""")
def q_count_schema(spark, sf):
    li = table(spark, sf, "lineitem")
    return ps.count_schema(li, "l_orderkey", "l_returnflag", "l_linenumber")


# --------------------------------------------------------------- F11 F12 F13 A2

# Fixed test symbols for formulas built from part keys.
SYMBOLS = ("H", "C", "N", "O", "Na", "Cl", "Fe", "Si", "Mg", "Ca")


def _part_formula() -> tuple[Column, Column]:
    k, s = F.col("p_partkey"), F.col("p_size")
    sym = F.array(*[F.lit(x) for x in SYMBOLS])
    e1 = F.element_at(sym, (s % 10 + 1).cast("int"))
    e2 = F.element_at(sym, (k % 10 + 1).cast("int"))
    c1 = k % 4 + 1
    c2 = (k % 3) * 2 + 2
    c1t = F.when(c1 == 1, F.lit("")).otherwise(c1.cast("string"))
    sep = F.when(k % 5 == 0, F.lit(" ")).otherwise(F.lit(""))
    good = F.concat(e1, c1t, sep, e2, c2.cast("string"))
    doubled = F.concat(e1, (c1 * 2).cast("string"), e2, (c2 * 2).cast("string"))
    bad = F.concat(e1, F.lit("0"), e2)
    return F.when(k % 13 == 0, bad).otherwise(good), doubled


_SQL_SYM = "[" + ", ".join(f"'{x}'" for x in SYMBOLS) + "]"


@register("formula_parse", f"""
WITH t AS (SELECT p_partkey, {_SQL_SYM}[p_size % 10 + 1] AS e1, {_SQL_SYM}[p_partkey % 10 + 1] AS e2,
                  p_partkey % 4 + 1 AS c1, (p_partkey % 3) * 2 + 2 AS c2 FROM part),
f AS (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN e1 || '0' || e2
                     ELSE e1 || CASE WHEN c1 = 1 THEN '' ELSE CAST(c1 AS VARCHAR) END
                          || CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '' END
                          || e2 || CAST(c2 AS VARCHAR) END AS formula,
                p_partkey % 13 = 0 AS bad FROM t)
SELECT p_partkey, formula,
  CASE WHEN bad THEN NULL WHEN e1 = e2 THEN '1'
       ELSE CAST(c1 // gcd(c1, c2) AS VARCHAR) || ':' || CAST(c2 // gcd(c1, c2) AS VARCHAR) END AS ratio,
  CASE WHEN bad THEN NULL ELSE CAST(c1 + c2 AS BIGINT) END AS n_atoms,
  CASE WHEN bad THEN NULL WHEN e1 = e2 THEN 1 ELSE 2 END AS n_elements,
  NOT bad AS same_as_doubled
FROM f""")
def q_formula_parse(spark, sf):
    good, doubled = _part_formula()
    p = table(spark, sf, "part").select("p_partkey", good.alias("formula"),
                                        doubled.alias("doubled"))
    counts = fm.formula_counts("formula")
    return p.select(
        "p_partkey", "formula", fm.ratio_text(counts).alias("ratio"),
        F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_atoms"),
        F.size(counts).alias("n_elements"),
        fm.same_reduced(counts, fm.formula_counts("doubled")).alias("same_as_doubled"))


# Forms of a grouped formula over two symbols, with the counts of both (an element that
# stands twice is one); a null form is invalid.  c1 and c2 are small positive numbers.
_GROUP_FORMS = (
    ("{a}({b}H2){2}", "1", "c2", "2 * c2"),
    ("[{a}({b}H){2}]{1}H", "c1", "c1 * c2", "c1 * c2 + 1"),
    ("{a}{1}{b}{2}\u00b75H2", "c1", "c2", "10"),
    ("{a}0.5{b}{2}H", "1", "2 * c2", "2"),
    ("{a}({b}0.5H1.50){1}*2{a}", "6", "c1", "3 * c1"),
    ("{a}({b}H{2}", None, None, None),
    ("{a}()({b}H)", None, None, None),
    ("{a}({b}H]{2}", None, None, None),
    ("{a}{b}\u00b7", None, None, None),
    ("{a}(({b}{2}))0H", None, None, None),
)


def _sql_group_forms() -> str:
    def text(form: str) -> str:
        parts = form.replace("{a}", "\0a\0").replace("{b}", "\0b\0").replace("{1}", "\0c1\0").replace("{2}", "\0c2\0")
        names = {"a": "e1", "b": "e2", "c1": "CAST(c1 AS VARCHAR)", "c2": "CAST(c2 AS VARCHAR)"}
        return " || ".join(names[x] if i % 2 else f"'{x}'" for i, x in enumerate(parts.split("\0")) if i % 2 or x)

    pick = lambda at: "CASE k " + " ".join(
        f"WHEN {i} THEN {text(f[0]) if at == 0 else f[at] or 'NULL'}" for i, f in enumerate(_GROUP_FORMS)) + " END"
    return f"""
WITH t AS (SELECT p_partkey, {_SQL_SYM}[p_size % 4 + 2] AS e1, {_SQL_SYM}[p_partkey % 4 + 6] AS e2,
                  p_partkey % 4 + 2 AS c1, p_size % 3 + 2 AS c2, p_partkey % {len(_GROUP_FORMS)} AS k FROM part),
f AS (SELECT *, {pick(0)} AS formula, {pick(1)} AS n1, {pick(2)} AS n2, {pick(3)} AS nh FROM t),
g AS (SELECT *, gcd(gcd(n1, n2), nh) AS g FROM f)
SELECT p_partkey, formula, CAST(n1 // g AS VARCHAR) || ':' || CAST(n2 // g AS VARCHAR) || ':' || CAST(nh // g AS VARCHAR)
         AS ratio, CAST((n1 + n2 + nh) // g AS BIGINT) AS n_reduced, n1 IS NOT NULL AS parses
FROM g"""


@register("formula_groups", _sql_group_forms())
def q_formula_groups(spark, sf):
    """F11 with groups, nesting, hydrate dots and decimals; unbalanced ones are invalid."""
    sym = F.array(*[F.lit(x) for x in SYMBOLS])
    k = F.col("p_partkey")
    part = {"{a}": F.element_at(sym, (F.col("p_size") % 4 + 2).cast("int")),
            "{b}": F.element_at(sym, (k % 4 + 6).cast("int")),
            "{1}": (k % 4 + 2).cast("string"), "{2}": (F.col("p_size") % 3 + 2).cast("string")}
    form = F.element_at(F.array(*[F.lit(f[0]) for f in _GROUP_FORMS]), (k % len(_GROUP_FORMS) + 1).cast("int"))
    for mark, value in part.items():
        form = F.replace(form, F.lit(mark), value)
    # a row is small and its work is not: parts are dealt out first, however few files hold them
    p = table(spark, sf, "part").select("p_partkey", "p_size").repartition("p_partkey")
    p = p.select("p_partkey", form.alias("formula"))
    p = p.select("*", fm.formula_counts("formula").alias("counts"))
    p = p.select("*", fm.reduced_counts("counts").alias("reduced"))
    return p.select(
        "p_partkey", "formula", fm.reduced_text("reduced").alias("ratio"),
        F.aggregate("reduced", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_reduced"),
        F.col("counts").isNotNull().alias("parses"))


# --------------------------------------------------------------- P3 P4 P5 P6

def _order_fields() -> tuple[Column, Column, Column, Column]:
    """Request formula, space group and a field map (with absent and empty
    entries) built from orders joined to customers."""
    k = F.col("o_orderkey")
    n = F.col("c_nationkey")
    sym = F.array(*[F.lit(x) for x in SYMBOLS])
    e1 = F.element_at(sym, (n % 10 + 1).cast("int"))
    e2 = F.element_at(sym, ((n + 5) % 10 + 1).cast("int"))
    formula = F.concat(e1, F.lit("2"), e2)
    sg = (F.col("o_custkey") % 230 + 1).cast("int")
    vals = {
        "formula": F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit(""))
                    .otherwise(F.concat(e1, F.lit(" 2 "), e2)),
        "reduced_ratio": F.when(F.col("o_orderstatus") == "O", F.lit("1:1")).otherwise(F.lit("2:1")),
        "condition_sg_number": F.when(k % 9 != 0, sg.cast("string")),
        "condition_crystal_system": F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("cubic"))
                                     .otherwise(lb.crystal_system(sg)),
        "target_cell_mode": F.lit("primitive"),
        "output_Z_raw": F.when(k % 6 == 0, F.lit("4.0")).when(k % 6 == 1, F.lit("-1"))
                         .when(k % 6 == 2, F.lit(None)).when(k % 6 == 3, F.lit(" 3 "))
                         .when(k % 6 == 4, F.lit("+2")).otherwise(F.lit("1")),
        "metric_family": F.col("c_mktsegment"),
        "length_pattern": F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.lit("ALL_EQ")),
        "angle_pattern": F.lit("ALL_EQ"),
        "vol_per_atom_bin": F.lit("V1"),
        "position_family": F.col("c_mktsegment"),
        "stack_family": F.when(k % 4 != 0, F.lit("NO_LAYER")),
        "site_schema": F.when(k % 2 == 0, F.lit("x:1")),
        "n_listed_sites": F.when(k % 3 == 0, F.lit("0")).when(k % 3 == 1, F.lit("x"))
                           .otherwise(F.lit("6")),
    }
    m = F.map_filter(F.create_map(*[x for kk, v in vals.items() for x in (F.lit(kk), v)]),
                     lambda _k, v: v.isNotNull())
    return formula, sg, m, k


@register("rules_codes", f"""
WITH t AS (
  SELECT o_orderkey AS k, o_orderstatus, o_orderpriority, c_acctbal, o_custkey % 230 + 1 AS sg
  FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (
  SELECT k, list_filter([
      CASE WHEN k % 5 IN (0, 1) THEN 'formula_mismatch' END,
      CASE WHEN o_orderstatus = 'O' THEN 'reduced_ratio_mismatch' END,
      CASE WHEN k % 9 = 0 THEN 'condition_sg_mismatch' END,
      CASE WHEN o_orderpriority = '2-HIGH' AND sg < 195 THEN 'crystal_system_mismatch' END,
      CASE WHEN k % 5 IN (0, 1) THEN 'missing_formula' END,
      CASE WHEN k % 9 = 0 THEN 'missing_condition_sg_number' END,
      CASE WHEN k % 6 = 2 THEN 'missing_output_Z_raw' END,
      CASE WHEN c_acctbal < 0 THEN 'missing_length_pattern' END,
      CASE WHEN k % 4 = 0 THEN 'missing_stack_family' END,
      CASE WHEN k % 6 IN (0, 1, 2) THEN 'bad_output_Z_raw' END], lambda x: x IS NOT NULL) AS core,
    list_filter([
      CASE WHEN k % 2 <> 0 THEN 'missing_site_schema' END,
      'missing_formula_sum_expected', 'missing_geometry_signature_v4', 'missing_prototype_bucket_v4',
      CASE WHEN k % 3 IN (0, 1) THEN 'bad_n_listed_sites' END], lambda x: x IS NOT NULL) AS extra
  FROM t)
SELECT k AS o_orderkey, len(core) = 0 AS valid_core, array_to_string(core, '|') AS codes_core,
       array_to_string(list_concat(core, extra), '|') AS codes_full
FROM c""")
def q_rules_codes(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"),
                                        F.col("o_custkey") == F.col("c_custkey"))
    formula, sg, m, k = _order_fields()
    t = o.select(k.alias("o_orderkey"), formula.alias("f"), sg.alias("sg"), m.alias("m"))
    t = rl.with_scaffold_checks(t, "m", "f", "sg", core="core", full="full")
    return t.select("o_orderkey", F.col("core.valid").alias("valid_core"),
                    F.array_join("core.errors", "|").alias("codes_core"),
                    F.array_join("full.errors", "|").alias("codes_full"))


# --------------------------------------------------------------- J1 D5 W6 F7 J4

def _part_ladder_fields() -> Column:
    return F.create_map(
        F.lit("prototype_bucket_v4"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")),
        F.lit("reduced_ratio"), F.col("p_brand"),
        F.lit("condition_sg_number"), F.col("p_type"),
        F.lit("metric_family"), (F.col("p_size") % 3).cast("string"))


def _hint_value() -> Column:
    return F.concat(F.col("p_type"), F.lit(" "), (F.col("p_size") % 7).cast("string"))


def _part_index(p: DataFrame) -> DataFrame:
    """Index (level, key, pos, row) built from part: every part is listed under
    its own three keys, in part-key order; rows are JSON objects (VARIANT)."""
    from cribra.operators.lookup import ladder_keys
    t = p.select("p_partkey", F.posexplode(ladder_keys(_part_ladder_fields())).alias("lv", "lk"),
                 F.parse_json(F.to_json(F.struct(_hint_value().alias("scaffold_full"))))
                 .alias("row"))
    t = t.select("p_partkey", F.col("lk.level").alias("level"), F.col("lk.key").alias("key"), "row")
    return sl.number_rows(t, ["level", "key"], "p_partkey", "pos").drop("p_partkey")


_SQL_LADDER = """
WITH base AS (
  SELECT p_partkey,
         p_brand || '/' || p_type || '/' || CAST(p_size AS VARCHAR) AS k1,
         p_brand || '|' || p_type || '|z|n|' || CAST(p_size % 3 AS VARCHAR) || '||' AS k2,
         p_brand || '|' || p_type || '|z|n' AS k3,
         p_type || ' ' || CAST(p_size % 7 AS VARCHAR) AS val
  FROM part),
idx AS (
  SELECT 1 AS level_no, k1 AS key, p_partkey AS pos, val FROM base
  UNION ALL SELECT 2, k2, p_partkey, val FROM base
  UNION ALL SELECT 3, k3, p_partkey, val FROM base),
req AS (
  SELECT p_partkey AS row_id, 1 AS level_no, k1 AS key FROM base
  UNION ALL SELECT p_partkey, 2, k2 FROM base
  UNION ALL SELECT p_partkey, 3, k3 FROM base),
j AS (SELECT r.row_id, i.level_no, i.pos, i.val FROM req r JOIN idx i USING (level_no, key)),
d AS (SELECT *, row_number() OVER (PARTITION BY row_id, val ORDER BY level_no, pos) AS rn FROM j),
h AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY level_no, pos) - 1 AS hint_no
      FROM d WHERE rn = 1)"""


@register("ladder_hints", _SQL_LADDER + """
SELECT row_id AS p_partkey,
  '<PROTOTYPE_HINTS_V4>' || chr(10)
  || string_agg('[hint_' || CAST(hint_no AS VARCHAR) || ']' || chr(10) || val, chr(10) ORDER BY hint_no)
  || chr(10) || '</PROTOTYPE_HINTS_V4>' AS hints
FROM h WHERE hint_no < 3 GROUP BY row_id""")
def q_ladder_hints(spark, sf):
    from cribra.operators.lookup import hint_block, ladder_join, ladder_keys, row_text
    p = table(spark, sf, "part")
    index = _part_index(p)
    reqs = p.select(F.col("p_partkey").alias("row_id"),
                    ladder_keys(_part_ladder_fields()).alias("keys"))
    hits = ladder_join(reqs, "keys", index.withColumn("hint", row_text(F.col("row"))),
                       F.to_json(F.col("row")), "hint", k=3)
    return hint_block(hits, "hint").select(F.col("row_id").alias("p_partkey"), "hints")


_CONST_HINT = "  Use the cubic rock-salt prototype.  "


@register("hint_override", _SQL_LADDER + f""",
b AS (
  SELECT row_id, '<PROTOTYPE_HINTS_V4>' || chr(10)
    || string_agg('[hint_' || CAST(hint_no AS VARCHAR) || ']' || chr(10) || val, chr(10) ORDER BY hint_no)
    || chr(10) || '</PROTOTYPE_HINTS_V4>' AS hints
  FROM h WHERE hint_no < 3 GROUP BY row_id)
SELECT p_partkey, {_sql_lit(_CONST_HINT.strip())} AS hints_const, '' AS hints_none,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE hints END AS hints_index
FROM part JOIN b ON p_partkey = row_id""")
def q_hint_override(spark, sf):
    """A constant text wins over index blocks; blocks alone; a request without
    blocks; neither."""
    from cribra.operators.lookup import attach_hints
    p = table(spark, sf, "part").select("p_partkey")
    blocks = q_ladder_hints(spark, sf).filter(F.col("p_partkey") % 3 != 0)
    out = p
    for name, text, b in (("hints_const", _CONST_HINT, blocks), ("hints_index", None, blocks),
                          ("hints_none", None, None)):
        named = None if b is None else b.withColumnRenamed("hints", name)
        out = attach_hints(out, "p_partkey", hint_text=text, blocks=named, name=name)
    return out


@register("index_json", _SQL_LADDER.split("req AS")[0].rstrip().rstrip(",") + """
SELECT 'level' || CAST(level_no AS VARCHAR) AS level, key, count(*) AS n_rows,
       count(DISTINCT val) AS n_distinct, arg_min(val, pos) AS first_val
FROM idx GROUP BY level_no, key""")
def q_index_json(spark, sf):
    """The part index written as JSON object documents (one line per list) to
    the shared folder, then read back with the index reader."""
    from cribra.operators.lookup import read_index, row_text
    from cribra.session import shared_path

    idx = _part_index(table(spark, sf, "part"))
    lists = (idx.groupBy("level", "key")
                .agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json("row").alias("j"))))
                     .alias("rows"))
                .select("level", "key", F.transform("rows", lambda r: r["j"]).alias("rows")))
    docs = lists.select(F.to_json(F.create_map("level", F.create_map("key", "rows"))).alias("value"))
    path = shared_path(spark, "index")
    docs.write.text(path)
    back = read_index(spark, path, layout="lines")
    t = back.select("level", "key", "pos", row_text(F.col("row")).alias("val"))
    return t.groupBy("level", "key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("val").alias("n_distinct"),
        F.min_by("val", "pos").alias("first_val"))


@register("index_object", _SQL_LADDER.split("req AS")[0].rstrip().rstrip(",") + """
SELECT 'level' || CAST(level_no AS VARCHAR) AS level, key, count(*) AS n_rows,
       count(DISTINCT val) AS n_distinct, arg_min(val, pos) AS first_val
FROM idx GROUP BY level_no, key""")
def q_index_object(spark, sf):
    """The part index written as one JSON object in one file, read by many tasks."""
    from cribra.operators.lookup import read_index, row_text
    from cribra.session import shared_path

    idx = _part_index(table(spark, sf, "part"))
    text = F.to_json("row")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("key", "pos")) == 1
    lines = idx.select("*", text.alias("_t"), first("level").alias("_l"), (F.row_number().over(
        Window.partitionBy("level", "key").orderBy("pos")) == 1).alias("_k"))
    name = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    # what stands before a row: the end of the list and of the level before it
    lines = lines.select("level", "key", "pos", F.concat(
        F.when(F.col("_l"), F.concat(F.when(F.col("level") == "level1", "{").otherwise("]},"), name("level"), F.lit(":{"),
                                     name("key"), F.lit(":[")))
         .when(F.col("_k"), F.concat(F.lit("],"), name("key"), F.lit(":["))).otherwise(","), "_t").alias("value"))
    end = spark.range(1).select(F.lit("zz").alias("level"), F.lit("").alias("key"), F.lit(0).alias("pos"),
                                F.lit("]}}").alias("value"))
    path = shared_path(spark, "index-object")
    lines.unionByName(end).repartition(1).sortWithinPartitions("level", "key", "pos") \
         .select("value").write.option("lineSep", " ").text(path)
    t = read_index(spark, path, split_bytes=4096).select("level", "key", "pos", row_text(F.col("row")).alias("val"))
    return t.groupBy("level", "key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("val").alias("n_distinct"),
        F.min_by("val", "pos").alias("first_val"))


# --------------------------------------------------------------- T1

def _event_text() -> Column:
    """key=value text built from event columns: a duplicated key (last wins), a
    line without separator, blanks around keys and values, a value holding '='."""
    k = F.col("event_id")
    return F.concat_ws(
        "\n", F.lit("<EVENT>"),
        F.concat(F.lit("event_type="), F.col("event_type")),
        F.concat(F.lit(" user = "), F.col("user_id").cast("string"), F.lit(" ")),
        F.lit("no separator here"),
        F.concat(F.lit("props="), F.col("props")),
        F.when(k % 5 == 0, F.concat(F.lit("event_type=late_"), F.col("event_type"))),
        F.concat(F.lit("expr=a=b"), (k % 3).cast("string")),
        F.lit("</EVENT>"))


@register("kv_table", """
SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN 'late_' || event_type ELSE event_type END AS event_type,
  CAST(user_id AS VARCHAR) AS user_text, props, 'a=b' || CAST(event_id % 3 AS VARCHAR) AS expr,
  4 AS n_keys
FROM events""")
def q_kv_table(spark, sf):
    from cribra.operators.parse import kv_map
    e = table(spark, sf, "events").select("event_id", kv_map(_event_text()).alias("m"))
    return e.select("event_id", F.col("m")["event_type"].alias("event_type"),
                    F.col("m")["user"].alias("user_text"), F.col("m")["props"].alias("props"),
                    F.col("m")["expr"].alias("expr"), F.cardinality("m").alias("n_keys"))


@register("kv_long", """
SELECT event_id, key, value FROM (
  SELECT event_id, 'event_type' AS key,
         CASE WHEN event_id % 5 = 0 THEN 'late_' || event_type ELSE event_type END AS value FROM events
  UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'props', props FROM events
  UNION ALL SELECT event_id, 'expr', 'a=b' || CAST(event_id % 3 AS VARCHAR) FROM events
  UNION ALL SELECT event_id, '<EVENT>' || chr(10) || 'x', NULL FROM events WHERE FALSE)""")
def q_kv_long(spark, sf):
    from cribra.operators.parse import kv_table
    e = table(spark, sf, "events").select("event_id", _event_text().alias("t"))
    return kv_table(e, "t", ["event_id"]).select("event_id", "key", "value")


# --------------------------------------------------------------- D3 D4

@register("error_lists", """
WITH t AS (
  SELECT o_orderkey, list_concat(
    list_filter([CASE WHEN o_orderstatus = 'F' THEN 'final' END,
                 CASE WHEN o_totalprice > 300000 THEN 'big' END,
                 CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL),
    list_filter([CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'even' END,
                 CASE WHEN o_orderstatus = 'F' THEN 'final' END], lambda x: x IS NOT NULL)) AS l
  FROM orders)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS codes
FROM t""")
def q_error_lists(spark, sf):
    o = table(spark, sf, "orders")
    a = rl.rules([("final", F.col("o_orderstatus") == "F"), ("big", F.col("o_totalprice") > 300000),
                  ("urgent", F.col("o_orderpriority").startswith("1"))])
    b = rl.rules([("urgent", F.col("o_orderpriority").startswith("1")),
                  ("even", F.col("o_orderkey") % 2 == 0), ("final", F.col("o_orderstatus") == "F")])
    return o.select("o_orderkey", F.array_join(rl.concat_codes(a, b), "|").alias("codes"))


# --------------------------------------------------------------- A3 A4 A7

@register("site_counts", """
SELECT l_orderkey, count(*) AS n_sites, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
       min(least(l_quantity, l_extendedprice / 1000, l_tax * 100)) AS min_least,
       CAST(sum(CASE WHEN least(l_quantity, l_extendedprice / 1000, l_tax * 100) <= 0 THEN 1 ELSE 0 END)
            AS BIGINT) AS n_zero
FROM lineitem GROUP BY l_orderkey""")
def q_site_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    lst = F.least("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_tax") * 100)
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.min(lst).alias("min_least"), F.sum(F.when(lst <= 0, 1).otherwise(0)).cast("bigint")
        .alias("n_zero"))


# --------------------------------------------------------------- F19 (+F10)

@register("derive_fields", f"""
WITH t AS (SELECT p_partkey, {_SQL_SYM}[p_size % 10 + 1] AS e1, {_SQL_SYM}[p_partkey % 10 + 1] AS e2,
                  p_partkey % 4 + 1 AS c1, (p_partkey % 3) * 2 + 2 AS c2, p_size % 4 AS z,
                  p_partkey % 13 = 0 AS bad, p_type, p_brand FROM part),
r AS (SELECT *, gcd(c1, c2) AS g FROM t)
SELECT p_partkey,
  CASE WHEN bad OR z = 0 THEN NULL WHEN e1 = e2 THEN e1 || ':' || CAST(z AS VARCHAR)
       ELSE e1 || ':' || CAST(c1 // g * z AS VARCHAR) || '|' || e2 || ':' || CAST(c2 // g * z AS VARCHAR) END
    AS site_schema,
  CASE WHEN bad OR z = 0 THEN NULL WHEN e1 = e2 THEN CAST(z AS VARCHAR)
       ELSE CAST((c1 + c2) // g * z AS VARCHAR) END AS n_listed_sites,
  CASE WHEN bad OR z = 0 THEN NULL WHEN e1 = e2 THEN e1 || CAST(z AS VARCHAR)
       ELSE e1 || CAST(c1 // g * z AS VARCHAR) || ' ' || e2 || CAST(c2 // g * z AS VARCHAR) END
    AS formula_sum_expected,
  CASE WHEN bad OR z = 0 THEN NULL ELSE p_type || '|ALL_EQ||V1' END AS geometry_signature_v4,
  CASE WHEN bad OR z = 0 THEN NULL ELSE '|' || p_brand || '|' || p_type || '|' || p_type || '|' END
    AS prototype_bucket_v4
FROM r""")
def q_derive_fields(spark, sf):
    good, _ = _part_formula()
    p = table(spark, sf, "part")
    m = F.map_filter(F.create_map(
        F.lit("output_Z_raw"), (F.col("p_size") % 4).cast("string"),
        F.lit("metric_family"), F.col("p_type"), F.lit("length_pattern"), F.lit("ALL_EQ"),
        F.lit("vol_per_atom_bin"), F.lit("V1"), F.lit("condition_sg_number"), F.col("p_brand"),
        F.lit("position_family"), F.col("p_type")), lambda _k, v: v.isNotNull())
    d = p.select("p_partkey", ps.derive_full_fields(m, good).alias("d"))
    return d.select("p_partkey", *[F.col("d")[k].alias(k) for k in (
        "site_schema", "n_listed_sites", "formula_sum_expected", "geometry_signature_v4",
        "prototype_bucket_v4")])


# --------------------------------------------------------------- P11

@register("penalty", """
WITH t AS (
  SELECT l_orderkey, l_linenumber,
    CASE l_linestatus WHEN 'F' THEN 'GENERAL_DOMINANT' ELSE 'MIXED_SPECIAL' END AS ep,
    CASE WHEN l_discount < 0.03 THEN 'NO_LAYER' WHEN l_discount < 0.07 THEN 'SKEW_DIAGONAL' ELSE 'OTHER' END AS es,
    CASE l_returnflag WHEN 'R' THEN 'HIGH_SPECIAL' WHEN 'A' THEN 'MIXED_SPECIAL' ELSE 'GENERAL' END AS p,
    CASE WHEN l_tax < 0.04 THEN 'LAYERED_AB' ELSE 'SKEW_DIAGONAL' END AS s
  FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN ep = 'GENERAL_DOMINANT' AND p IN ('HIGH_SPECIAL', 'MIXED_SPECIAL') THEN 2 ELSE 0 END
  + CASE WHEN ep = 'MIXED_SPECIAL' AND p = 'HIGH_SPECIAL' THEN 1 ELSE 0 END
  + CASE WHEN es = 'NO_LAYER' AND starts_with(s, 'LAYERED') THEN 2 ELSE 0 END
  + CASE WHEN es = 'SKEW_DIAGONAL' AND s <> 'SKEW_DIAGONAL' THEN 1 ELSE 0 END AS penalty
FROM t""")
def q_penalty(spark, sf):
    li = table(spark, sf, "lineitem")
    ep = F.when(F.col("l_linestatus") == "F", "GENERAL_DOMINANT").otherwise("MIXED_SPECIAL")
    es = (F.when(F.col("l_discount") < 0.03, "NO_LAYER")
           .when(F.col("l_discount") < 0.07, "SKEW_DIAGONAL").otherwise("OTHER"))
    p = (F.when(F.col("l_returnflag") == "R", "HIGH_SPECIAL")
          .when(F.col("l_returnflag") == "A", "MIXED_SPECIAL").otherwise("GENERAL"))
    s = F.when(F.col("l_tax") < 0.04, "LAYERED_AB").otherwise("SKEW_DIAGONAL")
    return li.select("l_orderkey", "l_linenumber", rl.collapse_penalty(ep, es, p, s).alias("penalty"))


# --------------------------------------------------------------- P1 (quarantine)

def _order_requests(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    v = (k % 240).cast("string")
    sg = (F.when(k % 6 == 0, F.concat(v, F.lit(".9"))).when(k % 6 == 1, F.concat(F.lit(" "), v))
          .when(k % 6 == 3, F.concat(F.lit("x"), v)).otherwise(v))
    return o.select(
        k.alias("row_id"),
        F.when(k % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" mp-"), F.col("o_custkey").cast("string")))
         .alias("material_id"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.concat(F.col("o_orderstatus"), F.lit("Cl")))
         .alias("pretty_formula"),
        sg.alias("space_group"))


@register("requests_check", """
WITH t AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderkey % 240 AS v FROM orders),
s AS (SELECT *, CASE WHEN k % 6 = 0 THEN CAST(v AS VARCHAR) || '.9' WHEN k % 6 = 1 THEN ' ' || CAST(v AS VARCHAR)
                     WHEN k % 6 = 3 THEN 'x' || CAST(v AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS sg_text
      FROM t)
SELECT k AS row_id,
  CASE WHEN k % 11 = 0 THEN '' ELSE 'mp-' || CAST(o_custkey AS VARCHAR) END AS material_id,
  CASE WHEN k % 13 = 0 THEN '' ELSE o_orderstatus || 'Cl' END AS pretty_formula,
  CASE WHEN k % 6 <> 3 AND v BETWEEN 1 AND 230 THEN CAST(v AS INTEGER) END AS space_group,
  CASE WHEN k % 11 = 0 OR k % 13 = 0
         THEN 'Empty material_id or pretty_formula at CSV line ' || CAST(k + 2 AS VARCHAR)
       WHEN k % 6 = 3 OR v NOT BETWEEN 1 AND 230
         THEN 'Invalid space_group at CSV line ' || CAST(k + 2 AS VARCHAR) || ': ' || sg_text END AS row_error
FROM s""")
def q_requests_check(spark, sf):
    from cribra.plans.jobs import check_requests
    return check_requests(_order_requests(table(spark, sf, "orders")))


# --------------------------------------------------------------- J3 P18 D6 A6

@register("left_outcome", """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(n, 0) AS n_candidates,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'skipped'
       WHEN n IS NULL THEN 'generation_failed' ELSE 'selected' END AS outcome
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def q_left_outcome(spark, sf):
    o = table(spark, sf, "orders")
    cands = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return o.join(cands, o.o_orderkey == cands.l_orderkey, "left").select(
        "o_orderkey", F.coalesce("n", F.lit(0)).alias("n_candidates"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("skipped"))
         .when(F.col("n").isNull(), F.lit("generation_failed"))
         .otherwise(F.lit("selected")).alias("outcome"))


# --------------------------------------------------------------- S1 + S4 round trip

def _tricky_text() -> Column:
    k = F.col("p_partkey")
    return (F.when(k % 5 == 0, F.concat(F.lit('say "'), "p_name", F.lit('"')))
             .when(k % 5 == 1, F.concat("p_name", F.lit("\nsecond, line")))
             .when(k % 5 == 2, F.concat(F.lit("  "), "p_name", F.lit("\\n")))
             .when(k % 5 == 3, F.lit(""))
             .otherwise(F.col("p_name")))


@register("csv_roundtrip", """
SELECT CAST(p_partkey AS VARCHAR) AS row_id, p_brand AS material_id,
  CASE WHEN p_partkey % 5 = 0 THEN 'say "' || p_name || '"'
       WHEN p_partkey % 5 = 1 THEN p_name || chr(10) || 'second, line'
       WHEN p_partkey % 5 = 2 THEN '  ' || p_name || '\\n'
       WHEN p_partkey % 5 = 3 THEN '' ELSE p_name END AS pretty_formula,
  CAST(p_size AS VARCHAR) AS space_group, row_number() OVER (ORDER BY p_partkey) - 1 AS line_no
FROM part""")
def q_csv_roundtrip(spark, sf):
    """S4 then S1: values with quotes, newlines, commas, backslashes, leading blanks
    and empty text read back equal; ``line_no`` over the written files is the order
    they were written in (L2)."""
    from cribra.session import shared_path
    from cribra.sources.io import read_requests, write_results
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("material_id"),
        _tricky_text().alias("pretty_formula"), F.col("p_size").alias("space_group"))
    path = shared_path(spark, "results")
    cols = ["row_id", "material_id", "pretty_formula", "space_group"]
    write_results(p, path, cols)
    back = read_requests(spark, path, cols, ordinal="line_no")
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols], "line_no")


_CSV_COLUMNS = ["row_id", "material_id", "pretty_formula", "space_group"]


def _tricky_parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("material_id"),
        _tricky_text().alias("pretty_formula"), F.col("p_size").alias("space_group"))


_TRICKY_SQL = """CASE WHEN p_partkey % 5 = 0 THEN 'say "' || p_name || '"'
       WHEN p_partkey % 5 = 1 THEN p_name || chr(10) || 'second, line'
       WHEN p_partkey % 5 = 2 THEN '  ' || p_name || '\\n'
       WHEN p_partkey % 5 = 3 THEN '' ELSE p_name END"""


@register("csv_splits", f"""
SELECT CAST(p_partkey AS VARCHAR) AS row_id, {_TRICKY_SQL} AS pretty_formula,
  row_number() OVER (ORDER BY p_partkey) - 1 AS line_no
FROM part""")
def q_csv_splits(spark, sf):
    """S1 on one file that is read in many splits, quoted line ends across their borders."""
    from cribra.session import shared_path
    from cribra.sources.io import read_requests, write_results
    path = shared_path(spark, "one-file")
    write_results(_tricky_parts(spark, sf), path, _CSV_COLUMNS, single_file=True)
    back = read_requests(spark, path, _CSV_COLUMNS, ordinal="line_no", split_bytes=4096)
    return back.select("row_id", F.coalesce("pretty_formula", F.lit("")).alias("pretty_formula"), "line_no")


@register("first_rows", f"""
SELECT CAST(p_partkey AS VARCHAR) AS row_id, {_TRICKY_SQL} AS pretty_formula, line_no
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS line_no FROM part)
WHERE line_no < 150""")
def q_first_rows(spark, sf):
    """L1: the first rows of a CSV of many files; later files are not read."""
    from cribra.session import shared_path
    from cribra.sources.io import read_requests, write_results
    path = shared_path(spark, "many-files")
    write_results(_tricky_parts(spark, sf), path, _CSV_COLUMNS)
    back = read_requests(spark, path, _CSV_COLUMNS, first_n=150, ordinal="line_no")
    return back.select("row_id", F.coalesce("pretty_formula", F.lit("")).alias("pretty_formula"), "line_no")


@register("text_file", """
SELECT regexp_replace(s_name, '[^A-Za-z0-9._-]+', '_', 'g') || '.txt' AS file,
       'supplier ' || s_name || chr(10) || 'nation ' || CAST(s_nationkey AS VARCHAR) AS text
FROM supplier""")
def q_text_file(spark, sf):
    """S6 then S3: a text file per supplier, read back as one stripped value each."""
    from cribra.session import shared_path
    from cribra.sources.io import read_text, text_files, write_text_files
    path = shared_path(spark, "texts")
    texts = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("row_id"), "s_name",
        F.concat(F.lit("  supplier "), "s_name", F.lit("\nnation "), F.col("s_nationkey").cast("string"),
                 F.lit(" \t\n")).alias("text"))
    write_text_files(text_files(texts, "s_name", "text", path, suffix=".txt"), path)
    return read_text(spark, path, file="file").select(
        F.element_at(F.split("file", "/"), -1).alias("file"), "text")
