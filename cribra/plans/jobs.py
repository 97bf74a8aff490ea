"""Whole jobs (survey Q1-Q4 with P1, P13-P18, D6, J3, A6, L1, L2).

Plan shape of both jobs: requests are checked with Column rules, responses are
hash-partitioned once by ``row_id`` and every later per-request step (dedupe,
numbering, cap, compile, verify, rank, best) reuses that partitioning; the
request attributes are joined on the same key.  The result is one row per
request, built with a left join so that requests without candidates keep a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cribra.functions.formula import formula_counts, reduced_counts, reduced_text
from cribra.functions.labels import (DEFAULT_ANGLE_EDGES, DEFAULT_RATIO_EDGES,
                                     DEFAULT_VPA_EDGES, ANGLE_LABELS, LENGTH_LABELS,
                                     bin_label, equal_pattern, ratio_bin_if)
from cribra.functions.text import (bool_text, collapse_ws, cut_from_marker, json_list, normalize_ws,
                                   remove_ws, strip_ws, text_or_empty, with_tagged_block)
from cribra.functions.util import col_of
from cribra.operators import parse as ps
from cribra.operators import rules as rl
from cribra.operators import select as sl
from cribra.session import shared_path, write_shared
from cribra.sources.io import bucket_count, write_bucketed

# Input and output column lists of the two batch jobs.
SCAFFOLD_INPUT = ("material_id", "pretty_formula", "space_group")
SCAFFOLD_OUTPUT = ("material_id", "pretty_formula", "space_group", "scaffold_core",
                   "scaffold_full", "valid_scaffold", "scaffold_errors")
CIF_INPUT = ("material_id", "pretty_formula", "space_group", "scaffold_full")
CIF_OUTPUT = ("material_id", "pretty_formula", "space_group", "scaffold_full", "cif_path",
              "selected_rank", "valid_cif", "canonicalized", "canonicalize_error",
              "consistency_score", "collapse_penalty", "verify_errors")
GENERAL_DOMINANT = "GENERAL_DOMINANT"
# Scaffold block tags are the caller's; these defaults are ours.
SCAFFOLD_BEGIN, SCAFFOLD_END = "<SCAFFOLD_CORE>", "</SCAFFOLD_CORE>"
LENGTH_TOL, ANGLE_TOL = 1e-3, 1e-2


class RequestError(ValueError):
    """First bad request row, raised on the driver before any write."""


# ------------------------------------------------------------------ P1 + L1

def check_requests(df: DataFrame, with_scaffold: bool = False) -> DataFrame:
    """Strip id/formula/scaffold, parse the space group, add ``row_error``
    with the CSV record number (records count from 2, H4)."""
    line = (F.col("row_id") + 2).cast("string")
    mid = strip_ws(F.coalesce(F.col("material_id").cast("string"), F.lit("")))
    formula = strip_ws(F.coalesce(F.col("pretty_formula").cast("string"), F.lit("")))
    sg = rl.parse_code(F.col("space_group"))
    err = (F.when((mid == "") | (formula == ""),
                  F.concat(F.lit("Empty material_id or pretty_formula at CSV line "), line))
            .when(sg.isNull(), F.concat(F.lit("Invalid space_group at CSV line "), line,
                                        F.lit(": "), F.coalesce(F.col("space_group").cast("string"),
                                                                F.lit("None")))))
    cols = [F.col("row_id"), mid.alias("material_id"), formula.alias("pretty_formula"),
            sg.alias("space_group")]
    if with_scaffold:
        cols.append(strip_ws(F.coalesce(F.col("scaffold_full"), F.lit(""))).alias("scaffold_full"))
    return df.select(*cols, err.alias("row_error"))


def split_requests(df: DataFrame, with_scaffold: bool = False, on_error: str = "fail",
                   require: str | None = None) -> tuple[DataFrame, DataFrame]:
    """P1 with both policies: ``fail`` raises the first bad row's message,
    ``quarantine`` returns ``(good, bad)``.

    With ``fail`` the checked rows are written to the shared folder once, and the first
    error is found while they are written, so that the input is read a single time;
    what is returned reads that table.  Nothing else has been written when it raises.
    ``require`` names the input in the error for a table without rows.
    """
    checked = check_requests(df, with_scaffold)
    if on_error == "fail":
        obs = Observation("requests")
        checked = write_shared(checked.observe(
            obs, F.min_by("row_error", F.when(F.col("row_error").isNotNull(), F.col("row_id"))).alias("first"),
            F.count(F.lit(1)).alias("rows")), "requests")
        if obs.get["first"] is not None:
            raise RequestError(obs.get["first"])
        if require is not None and not obs.get["rows"]:
            raise ValueError(f"No rows in {require}")
    elif on_error != "quarantine":
        raise ValueError("on_error must be 'fail' or 'quarantine'")
    good = checked.filter(F.col("row_error").isNull()).drop("row_error")
    return good, checked.filter(F.col("row_error").isNotNull())


# ------------------------------------------------------------------ D1 W1 W2

def prepare_responses(responses: DataFrame, n: int | None, key: str = "row_id", seq: str = "seq",
                      text: str = "response", presorted: bool = False,
                      keep: Sequence[str] = ()) -> DataFrame:
    """D1 + W1 + W2: per request, drop blank responses, keep the first of each
    whitespace-normalised text (stripped original kept), number 0.. in response
    order, keep the first ``n``.

    Both windows are by ``key`` alone: responses that lie by it already (a join or window
    on ``key``, a bucketed table) move no more, others move once; ``presorted``, which said
    so, makes no difference any more.  What is compared is a 256-bit digest of the
    normalised text, so that sorting moves no second text.  Responses per request are
    bounded by the generator's sample count.
    """
    r = responses.select(key, seq, *keep, strip_ws(text).alias("response"))
    r = r.withColumn("_k", F.unhex(F.sha2(collapse_ws("response"), 256)))
    # a blank text equals blank ones only; a filter in front would make each text twice
    r = sl.dedupe_first(r, key, "_k", seq, together=True).filter(F.col("response") != "")
    return sl.number_rows(r, key, seq, "rank", limit=n).drop("_k")


def generation_failure(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with ``_why``: the reason that U1 gave for a request's failure, as
    a list of no or one code (``generation_failed:<reason>``)."""
    if "error" not in responses.columns:
        return requests.withColumn("_why", F.array().cast("array<string>"))
    why = responses.filter(F.col("error").isNotNull()).groupBy("row_id").agg(F.min("error").alias("_e"))
    return requests.join(why, "row_id", "left").withColumn("_why", F.when(
        F.col("_e").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("generation_failed:"), "_e")))).drop("_e")


# ------------------------------------------------------------------ Q1

REQUEST_COUNTS = ("req_counts", "req_ratio")


def with_request_counts(requests: DataFrame) -> DataFrame:
    """Adds ``req_counts`` and ``req_ratio``: reduced counts (A2) and ratio (F12) of the
    request formula, null when it does not parse."""
    out = requests.select("*", reduced_counts(formula_counts("pretty_formula")).alias("req_counts"))
    return out.select("*", reduced_text("req_counts").alias("req_ratio"))


def compile_scaffolds(cands: DataFrame, begin: str = SCAFFOLD_BEGIN,
                      end: str = SCAFFOLD_END) -> DataFrame:
    """P14 per candidate: extract the core block (F3), parse (T1), check (P6);
    only a valid core is compiled to the full text (F19) and rechecked with the
    full rules.  Adds scaffold_core, scaffold_full, valid_scaffold,
    scaffold_errors, fields.

    Candidates of ``with_request_counts`` bring what the request formula gives, so it is
    parsed once a request.
    """
    kept = [x for x in cands.columns if x not in REQUEST_COUNTS]
    if len(kept) == len(cands.columns):
        cands = with_request_counts(cands)
    c = with_tagged_block(cands, "response", begin, end, "scaffold_core", "_tag_err")
    c = c.withColumn("_core_fields", ps.kv_map("scaffold_core"))
    c = rl.with_scaffold_checks(c, "_core_fields", "pretty_formula", "space_group", core="_core_chk",
                                ratio="req_ratio")
    core_ok = F.col("_core_chk.valid") & F.col("_tag_err").isNull()
    c = c.withColumn("_derived", F.when(core_ok, ps.derive_full_fields("_core_fields", "pretty_formula",
                                                                       "req_counts")))
    c = c.withColumn("_full", F.when(core_ok, ps.compile_full_text("scaffold_core", "_derived")))
    # what parsing the full text again would give: its derived lines come last
    c = c.withColumn("_full_fields", F.when(F.col("_full").isNotNull(), F.map_concat(
        F.map_filter("_core_fields", lambda k, _: ~k.isin(*rl.REQUIRED_FULL)), "_derived")))
    c = rl.with_scaffold_checks(c, "_full_fields", "pretty_formula", "space_group", full="_full_chk",
                                ratio="req_ratio")
    compiled = core_ok & F.col("_full").isNotNull()
    errors = (F.when(F.col("_tag_err").isNotNull(), F.array(F.col("_tag_err")))
               .when(~core_ok, F.col("_core_chk.errors"))
               .when(~compiled, F.array(F.lit("compile_full_failed:bad_formula_or_Z")))
               .otherwise(F.col("_full_chk.errors")))
    return c.select(
        *kept,
        F.coalesce(F.col("scaffold_core"), F.lit("")).alias("scaffold_core"),
        F.coalesce(F.col("_full"), F.lit("")).alias("scaffold_full"),
        F.when(compiled, F.col("_full_chk.valid")).otherwise(F.lit(False)).alias("valid_scaffold"),
        F.array_distinct(errors).alias("scaffold_errors"),
        F.when(compiled, F.col("_full_fields")).otherwise(F.col("_core_fields")).alias("fields"),
    )


def scaffold_ranking() -> list[Column]:
    """W3 keys: valid first, fewer errors, GENERAL_DOMINANT position first,
    longer full text first, then response order (stable sort)."""
    return [F.col("valid_scaffold").desc(), F.size("scaffold_errors").asc(),
            F.coalesce(F.try_element_at(F.col("fields"), F.lit("position_family"))
                       == GENERAL_DOMINANT, F.lit(False)).desc(),
            F.length("scaffold_full").desc(), F.col("rank").asc()]


def scaffold_candidates(requests: DataFrame, responses: DataFrame, n: int,
                        begin: str = SCAFFOLD_BEGIN, end: str = SCAFFOLD_END,
                        bucketed: bool = False) -> DataFrame:
    """Q1 candidate table: D1/W1/W2, P14, D2 on the compiled text, W3 ranking.

    ``bucketed``: both tables are stored in buckets of ``row_id`` (``io.write_bucketed``),
    so nothing is exchanged.
    """
    cands = prepare_responses(responses, n)
    req = requests.select("row_id", "pretty_formula", "space_group")
    cands = cands.join(with_request_counts(req), "row_id")
    comp = compile_scaffolds(cands, begin, end)
    comp = comp.withColumn("_fk", normalize_ws("scaffold_full"))
    comp = sl.dedupe_first(comp, "row_id", "_fk", "rank", keep_blank=True).drop("_fk")
    return sl.rank_candidates(comp, "row_id", scaffold_ranking())


def scaffold_job(requests: DataFrame, responses: DataFrame, n: int = 6,
                 begin: str = SCAFFOLD_BEGIN, end: str = SCAFFOLD_END,
                 bucketed: bool = False) -> DataFrame:
    """Q1: one result row per request (P17): best candidate or empty text and
    ``["generation_failed"]``; an invalid best is still reported.  ``bucketed`` as in
    ``scaffold_candidates``."""
    if n < 1:
        raise ValueError("num_samples must be positive")
    best = scaffold_candidates(requests, responses, n, begin, end, bucketed) \
        .filter(F.col("order_no") == 1) \
        .select("row_id", F.col("scaffold_core").alias("_core"),
                F.col("scaffold_full").alias("_full"), F.col("valid_scaffold").alias("_valid"),
                F.col("scaffold_errors").alias("_errors"))
    out = generation_failure(responses, requests).join(best, "row_id", "left")
    has = F.col("_errors").isNotNull()
    return out.select(
        "row_id", "material_id", "pretty_formula",
        F.col("space_group").cast("string").alias("space_group"),
        strip_ws(F.coalesce("_core", F.lit(""))).alias("scaffold_core"),
        strip_ws(F.coalesce("_full", F.lit(""))).alias("scaffold_full"),
        bool_text(F.coalesce("_valid", F.lit(False))).alias("valid_scaffold"),
        json_list(F.when(has, F.col("_errors"))
                   .otherwise(F.concat(F.array(F.lit("generation_failed")), "_why")))
        .alias("scaffold_errors"))


# ------------------------------------------------------------------ Q2 verify

def cell_volume(r: Column) -> Column:
    """Triclinic cell volume from lengths and angles (degrees)."""
    ca, cb, cg = (F.cos(F.radians(r[x])) for x in ("alpha", "beta", "gamma"))
    inner = F.lit(1.0) - ca * ca - cb * cb - cg * cg + F.lit(2.0) * ca * cb * cg
    return r["cell_a"] * r["cell_b"] * r["cell_c"] * F.sqrt(F.greatest(inner, F.lit(0.0)))


# Fields compared with the scaffold, and those compared only where present.
VERIFY_FIELDS = ("site_schema", "metric_family", "length_pattern", "angle_pattern", "vol_per_atom_bin",
                 "position_family", "stack_family")
VERIFY_OPTIONAL = ("eq_angle_bin", "gamma_bin", "b_over_a_bin", "c_over_a_bin_family")


def record_labels(r: Column, n_sites: Column | None = None, angle_edges=DEFAULT_ANGLE_EDGES, ratio_edges=DEFAULT_RATIO_EDGES,
                  vpa_edges=DEFAULT_VPA_EDGES) -> dict[str, Column]:
    """Geometry labels of a parsed record (F14-F16; edges and tolerances are ours)."""
    lp = equal_pattern(r["cell_a"], r["cell_b"], r["cell_c"], LENGTH_TOL, LENGTH_LABELS)
    ap = equal_pattern(r["alpha"], r["beta"], r["gamma"], ANGLE_TOL, ANGLE_LABELS)
    n_sites = F.size(r["sites"]) if n_sites is None else n_sites
    vpa = F.when(n_sites > 0, cell_volume(r) / n_sites)
    abin = lambda x: bin_label(x, angle_edges, prefix="A")
    eq_bin = (F.when(ap.isin(ANGLE_LABELS[1], ANGLE_LABELS[2]), abin(r["alpha"]))
               .when(ap == ANGLE_LABELS[3], abin(r["beta"])).otherwise(F.lit("")))
    return {
        "length_pattern": lp,
        "angle_pattern": ap,
        "vol_per_atom_bin": bin_label(vpa, vpa_edges, prefix="V"),
        "eq_angle_bin": eq_bin,
        "gamma_bin": abin(r["gamma"]),
        "b_over_a_bin": ratio_bin_if(lp, r["cell_b"], r["cell_a"], ratio_edges, LENGTH_LABELS[4],
                                     prefix="R"),
        "c_over_a_bin_family": bin_label(r["cell_c"] / F.greatest(r["cell_a"], F.lit(1e-8)),
                                         ratio_edges, prefix="C"),
    }


def verify_candidates(df: DataFrame, record: str = "record", fields: str = "scaffold_fields",
                      scaffold_check: str = "scaffold_check", labels: Sequence[str] = (
                          "metric_family", "position_family", "stack_family"),
                      counts: str | None = None, n_sites: str | None = None) -> DataFrame:
    """Rule set of a parsed record against the request's full scaffold.

    Early exits: invalid scaffold -> ``invalid_scaffold:<code>`` per code, -999,
    999; unparsable text -> ``parse_failed:<msg>``, -999, 999, no cif_fields.
    ``metric_family``/``position_family``/``stack_family`` arrive as columns, and
    ``counts`` (A1 of the sites) and ``n_sites`` may.  Expected values, labels and
    conditions become columns one step after the other, so each is computed once and
    the rules are plain generated code.
    """
    r, m = F.col(record), F.col(fields)
    expected = VERIFY_FIELDS + VERIFY_OPTIONAL + ("output_Z_raw", "n_listed_sites")
    if counts is None:
        df_counts = ps.element_counts(F.transform(r["sites"], lambda s: s["element"]))
    else:
        df_counts = F.col(counts)
    out = df.select("*", df_counts.alias("_counts"),
                    (F.size(r["sites"]) if n_sites is None else F.col(n_sites)).alias("_n"),
                    *[F.try_element_at(m, F.lit(k)).alias(f"_want_{k}") for k in expected],
                    *_formula_texts(df, r["formula_structural"]))
    geo = record_labels(r, F.col("_n"))
    out = out.select("*", ps.schema_text("_counts").alias("_is_site_schema"),
                     *[F.col(c).alias(f"_is_{k}") for k, c in zip(
                         ("metric_family", "position_family", "stack_family"), labels)],
                     *[v.alias(f"_is_{k}") for k, v in geo.items()],
                     _formula_differs(df, r["formula_structural"]).alias("_formula"))
    want, has = (lambda k: F.col(f"_want_{k}")), (lambda k: F.col(f"_is_{k}"))
    differs = lambda k: want(k).isNotNull() & ~has(k).eqNullSafe(want(k))
    number = lambda k: rl.int_text(want(k))
    # Codes and their order.
    pairs = [
        ("empty_atom_sites", F.col("_n") == 0),
        ("zero_lattice", F.least(r["cell_a"], r["cell_b"], r["cell_c"]) <= 0),
        ("formula_structural_mismatch", F.col("_formula")),
        ("output_Z_raw_mismatch", ~r["z"].cast("bigint").eqNullSafe(number("output_Z_raw"))),
        ("n_listed_sites_mismatch", ~F.col("_n").cast("bigint").eqNullSafe(number("n_listed_sites"))),
    ] + [(f"{k}_mismatch", differs(k)) for k in VERIFY_FIELDS + VERIFY_OPTIONAL]
    out = out.select("*", *[F.coalesce(cond, F.lit(False)).alias(f"_if_{code}") for code, cond in pairs])
    held = lambda codes: sum((F.col(f"_if_{c}").cast("int") for c in codes), F.lit(0))
    codes = [code for code, _ in pairs]
    out = out.select(
        "*", rl.rules([(c, F.col(f"_if_{c}")) for c in codes]).alias("_errs"),
        rl.collapse_penalty(want("position_family"), want("stack_family"), F.col(labels[1]),
                            F.col(labels[2])).alias("_pen"),
        held([c for c in codes if c in rl.HARD_CODES]).alias("_hard"),
        held([c for c in codes if c not in rl.HARD_CODES]).alias("_soft"),
        F.col(scaffold_check)["valid"].alias("_ok"), r["parse_error"].alias("_bad"))
    failed = ~F.col("_ok") | F.col("_bad").isNotNull()
    cif_fields = F.struct(
        r["formula_structural"].alias("formula"), r["z"].alias("output_Z_raw"),
        F.col("_n").alias("n_listed_sites"), *[has(k).alias(k) for k in VERIFY_FIELDS + VERIFY_OPTIONAL])
    out = out.select(
        *df.columns,
        F.when(~F.col("_ok"), rl.prefixed(F.col(scaffold_check)["errors"], "invalid_scaffold:"))
         .when(F.col("_bad").isNotNull(), F.array(F.concat(F.lit("parse_failed:"), "_bad")))
         .otherwise(F.col("_errs")).alias("verify_errors"),
        F.when(failed, F.lit(rl.FAILED_SCORE))
         .otherwise(rl.score(F.col("_hard"), F.col("_soft"), F.col("_pen"))).alias("consistency_score"),
        F.when(failed, F.lit(rl.FAILED_PENALTY)).otherwise(F.col("_pen")).alias("collapse_penalty"),
        F.when(~failed, cif_fields).alias("cif_fields"))
    return out.select(*df.columns, (F.size("verify_errors") == 0).alias("valid_cif"), "verify_errors",
                      "consistency_score", "collapse_penalty", "cif_fields")


def request_reduced(formula) -> Column:
    """Order-free reduced counts of a formula (null when it does not parse)."""
    return F.array_sort(reduced_counts(formula_counts(formula)))


def _formula_texts(df: DataFrame, record_formula: Column) -> list[Column]:
    """Whether request and record hold one formula text: then nothing is parsed."""
    if "req_reduced" not in df.columns:
        return []
    same = remove_ws(F.coalesce(record_formula, F.lit(""))) == remove_ws("pretty_formula")
    return [F.coalesce(same, F.lit(False)).alias("_same_text")]


def _formula_differs(df: DataFrame, record_formula: Column) -> Column:
    """F13 against the request: uses the per-request ``req_reduced`` column when
    present, else parses the request formula here."""
    if "req_reduced" not in df.columns:
        return ~rl.formula_matches("pretty_formula", record_formula)
    cand = request_reduced(F.coalesce(record_formula, F.lit("")))
    return F.when(F.col("_same_text"), F.col("req_reduced").isNull()) \
            .otherwise(~F.coalesce(cand == F.col("req_reduced"), F.lit(False)))


def canonical_record(rec: Column) -> Column:
    """The record as re-read from its canonical text: values at six decimals,
    empty name/formula shown as ``unknown`` (saves a second parse); a record that
    failed to parse as it is."""
    ok = rec["parse_error"].isNull()
    # what is printed at six decimals reads back as this; the sign of a zero is kept
    r6 = lambda x: F.when(F.abs(x) < 5e-7, x * 0.0).otherwise(F.round(x, 6))
    shown = lambda x, y: F.when(ok, y).otherwise(x)
    fs = F.coalesce(rec["formula_structural"], F.lit(""))
    return F.struct(
        shown(rec["name"], F.when(rec["name"] == "", F.lit("unknown")).otherwise(rec["name"])).alias("name"),
        shown(rec["formula_structural"], F.when(fs == "", F.lit("unknown")).otherwise(fs))
        .alias("formula_structural"),
        rec["formula_sum"].alias("formula_sum"),
        *[shown(rec[k], r6(rec[k])).alias(k) for k in ("cell_a", "cell_b", "cell_c", "alpha", "beta", "gamma")],
        rec["z"].alias("z"),
        shown(rec["sites"], F.transform(rec["sites"], lambda s: F.struct(
            s["element"].alias("element"), r6(s["x"]).alias("x"), r6(s["y"]).alias("y"),
            r6(s["z"]).alias("z")))).alias("sites"),
        rec["parse_error"].alias("parse_error"))


def cif_ranking() -> list[Column]:
    """W4 keys: valid, score desc, penalty asc, canonicalized, response order."""
    return [F.col("valid_cif").desc(), F.col("consistency_score").desc(),
            F.col("collapse_penalty").asc(), F.col("canonicalized").desc(), F.col("rank").asc()]


LABELS = ("metric_family", "position_family", "stack_family")


def crystal_candidates(requests: DataFrame, responses: DataFrame, n: int | None = 1,
                       labels: DataFrame | None = None,
                       labelers: dict[str, Callable[[Column], Column]] | None = None,
                       bucketed: bool = False, texts: bool = True) -> DataFrame:
    """Q2 candidate table: D1/W1/W2, F4 + T3, T2, P13, W4 ranking.

    ``requests`` must already be filtered to rows with a scaffold (P18).
    Labels (metric/position/stack family) are best supplied as columns of
    ``responses`` (no extra join, the row_id partitioning is kept); a separate
    ``labels`` table ``(row_id, seq, ...)`` is joined on the capped candidates
    otherwise.  ``labelers`` compute labels from the parsed record (name -> function
    of its Column) and win over both.  Missing labels read as empty text; ``n`` None
    keeps every distinct response; without ``texts`` the responses are left out.

    Spark does not know how the rows lie after a Python step (T1, T2).  So requests are
    parsed before they are dealt out, and candidates are dealt out again for the ranking,
    when little of them is left.  With ``bucketed`` both are stored in the same buckets
    again instead, which exchanges nothing.
    """
    spark = requests.sparkSession
    buckets = bucket_count(responses.groupBy("row_id").count()) if bucketed else 0

    def laid(df, name):
        return write_bucketed(df, shared_path(spark, name), buckets=buckets, dealt=True) if bucketed else df

    req = requests.select("row_id", "pretty_formula", "space_group", "scaffold_full") \
        .withColumn("scaffold_fields", ps.kv_map_batches("scaffold_full"))
    req = rl.with_scaffold_checks(with_request_counts(req), "scaffold_fields", "pretty_formula", "space_group",
                                  full="scaffold_check", ratio="req_ratio").drop("scaffold_full")
    req = laid(req.withColumn("req_reduced", F.array_sort("req_counts")).drop(*REQUEST_COUNTS), "parsed-requests")
    inline = [c for c in LABELS if c in responses.columns]
    cands = prepare_responses(responses, n, keep=inline)
    if labels is not None and not inline:
        cands = cands.join(labels, ["row_id", "seq"], "left")
    elif not inline:
        cands = cands.select("*", *[F.lit(None).cast("string").alias(c) for c in LABELS])
    for c in LABELS:
        cands = cands.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    if not bucketed:
        cands = cands.join(req, "row_id")
    cands = cands.withColumn("_cut", cut_from_marker("response"))
    cands = ps.with_crystal_record(cands if texts else cands.drop("response"), "_cut", "_rec", canonical=True)
    if bucketed:
        cands = laid(cands, "parsed-responses").join(req, "row_id")
    cands = ps.with_canonical(cands, "_rec", "_cut")
    cands = cands.select("*", F.size("_rec.sites").alias("n_sites"), canonical_record(F.col("_rec")).alias("record"))
    cands = cands.drop("_cut", "_rec")
    for c, fn in (labelers or {}).items():
        cands = cands.withColumn(c, F.coalesce(fn(F.col("record")), F.lit("")))
    ver = verify_candidates(cands, counts="counts", n_sites="n_sites").drop("counts", "n_sites")
    return sl.rank_candidates(ver, "row_id", cif_ranking())


def crystal_job(requests: DataFrame, responses: DataFrame, n: int = 1, strict: bool = False,
                out_dir: str = "", labels: DataFrame | None = None,
                labelers: dict[str, Callable[[Column], Column]] | None = None,
                bucketed: bool = False) -> DataFrame:
    """Q2: one result row per request (P16 routing, first match wins):
    ``missing_scaffold_full`` -> ``generation_failed`` -> strict reject ->
    success.  Adds ``outcome`` and ``cif`` (text of accepted rows) beside the
    CSV columns.  ``bucketed`` as in ``scaffold_candidates``."""
    if n < 1:
        raise ValueError("num_samples must be positive")
    with_scaffold = requests.filter(F.col("scaffold_full") != "")   # P18, before generation
    best = crystal_candidates(with_scaffold, responses, n, labels, labelers, bucketed, texts=False) \
        .filter(F.col("order_no") == 1) \
        .select("row_id", F.col("rank").alias("_rank"), F.col("valid_cif").alias("_valid"),
                F.col("canonicalized").alias("_canon"),
                F.col("canonicalize_error").alias("_cerr"),
                F.col("consistency_score").alias("_score"),
                F.col("collapse_penalty").alias("_pen"),
                F.col("verify_errors").alias("_errs"), F.col("cif").alias("_cif"))
    return summarize(generation_failure(responses, requests).join(best, "row_id", "left"),
                     strict, out_dir)


def summarize(df: DataFrame, strict: bool, out_dir: str = "") -> DataFrame:
    """P15 + P16: route every request to one outcome and render the CSV columns."""
    from cribra.functions.text import safe_stem

    no_scaffold = F.col("scaffold_full") == ""
    no_best = F.col("_rank").isNull()
    reject = F.lit(strict) & ~F.coalesce(F.col("_valid"), F.lit(False))
    outcome = (F.when(no_scaffold, F.lit("missing_scaffold_full"))
                .when(no_best, F.lit("generation_failed"))
                .when(reject, F.lit("no_valid_cif_candidate"))
                .otherwise(F.lit("success")))
    failed = no_scaffold | no_best
    path = F.concat(F.lit(out_dir.rstrip("/") + "/" if out_dir else ""), safe_stem("material_id"),
                    F.lit(".cif"))
    return df.select(
        "row_id", "material_id", "pretty_formula",
        F.col("space_group").cast("string").alias("space_group"), "scaffold_full",
        F.when(failed | reject, F.lit("")).otherwise(path).alias("cif_path"),
        F.when(failed, F.lit("")).otherwise(F.col("_rank").cast("string")).alias("selected_rank"),
        F.when(failed, F.lit("False")).otherwise(bool_text("_valid")).alias("valid_cif"),
        F.when(failed, F.lit("False")).otherwise(bool_text("_canon")).alias("canonicalized"),
        F.when(failed, outcome).otherwise(text_or_empty("_cerr")).alias("canonicalize_error"),
        F.when(failed, F.lit("")).otherwise(F.col("_score").cast("string")).alias("consistency_score"),
        F.when(failed, F.lit("")).otherwise(F.col("_pen").cast("string")).alias("collapse_penalty"),
        json_list(F.when(no_scaffold, F.array(outcome))
                   .when(no_best, F.concat(F.array(outcome), "_why"))
                   .otherwise(F.col("_errs"))).alias("verify_errors"),
        outcome.alias("outcome"),
        F.when(~failed & ~reject, F.concat(strip_ws("_cif"), F.lit("\n"))).alias("cif"))


# ------------------------------------------------------------------ Q3 / Q4

def best_and_all(cands: DataFrame, payload: Sequence[str], require_best: bool = True,
                 requests: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Q3 + A5: per request ``{best, all}`` with candidates in ranked order.

    With ``requests`` every request keeps its row; ``require_best`` then fails the
    job when one has no candidate, as the single-request programs do, and without it
    its ``best`` is null and ``all`` empty.  ``strict`` adds ``error``:
    ``no_valid_cif_candidate`` beside the top candidate when that one is not valid.
    """
    out = sl.collect_ranked(cands, "row_id", "order_no", list(payload))
    out = out.select("row_id", F.col("all")[0].alias("best"), "all")
    if requests is not None:
        out = requests.select("row_id").join(out, "row_id", "left")
        none = F.array().cast(out.schema["all"].dataType)
        out = out.withColumn("all", F.coalesce("all", none))
    if require_best:
        out = out.withColumn("best", F.when(F.col("best").isNotNull(), F.col("best"))
                             .otherwise(F.raise_error(F.lit("No candidate was generated"))))
    if strict:
        out = out.withColumn("error", F.when(~F.coalesce("best.valid_cif", F.lit(False)),
                                             F.lit("no_valid_cif_candidate")))
    return out


def chained_requests(scaffold_results: DataFrame) -> DataFrame:
    """Q4: Q1's output columns are a superset of Q2's input columns."""
    return scaffold_results.select("row_id", *CIF_INPUT)


# ------------------------------------------------------------------ prompts

def request_text(formula="pretty_formula", sg="space_group",
                 template: str = "{formula} | space group {sg}") -> Column:
    """Request text of a prompt (the reference's formatter is absent; the
    template is the caller's, this default is ours)."""
    head, rest = template.split("{formula}")
    mid, tail = rest.split("{sg}")
    return F.concat(F.lit(head), strip_ws(col_of(formula)), F.lit(mid),
                    col_of(sg).cast("string"), F.lit(tail))


def scaffold_prompts(requests: DataFrame, instruction: str, name: str = "prompt") -> DataFrame:
    """Q1 prompts: instruction + request text."""
    from cribra.functions.text import render_prompt
    return requests.withColumn(name, render_prompt(F.lit(instruction), request_text()))


def crystal_prompts(requests: DataFrame, instruction: str, hints: str | None = None,
                    name: str = "prompt") -> DataFrame:
    """Q2 prompts (F6): request text, blank line, scaffold, optional hint block."""
    from cribra.functions.text import prompt_body, render_prompt
    body = prompt_body(request_text(), F.col("scaffold_full"),
                       F.col(hints) if hints else None)
    return requests.withColumn(name, render_prompt(F.lit(instruction), body))
