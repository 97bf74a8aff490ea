"""Text-to-table operators (survey T1, T2, T3, A1, A3, F19).

Each parser is a Column over one text column, so it runs inside the scan stage with no
shuffle; crystal texts are parsed over Arrow batches, all else is Catalyst.  A record's sites
stay an in-row array (bounded by the record); ``site_table`` gives the long
form when a caller wants one row per site.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.functions.formula import counts_text, formula_counts, reduced_counts, scale_counts
from cribra.functions.text import WS_CLASS, int_text, strip_ws
from cribra.functions.util import col_of, let, materialize
from cribra.operators.crystal import CELL_TAGS, MADE_DDL, RECORD_DDL, canonical_records, records

# ---------------------------------------------------------------- T1 key=value

def kv_entries(c, sep: str = "=") -> Column:
    """Lines of ``key<sep>value`` -> ``ARRAY<STRUCT<k, v, i>>`` in line order.

    Split at the first separator, both sides stripped; lines without a
    separator or with an empty key are skipped (tag lines, blank lines).
    """
    lines = F.split(F.coalesce(col_of(c), F.lit("")), r"\r\n|\r|\n")
    pairs = F.transform(lines, lambda line, i: F.struct(
        strip_ws(F.substring_index(line, sep, 1)).alias("k"),
        strip_ws(F.when(F.instr(line, sep) > 0,
                        F.call_function("substr", line, F.instr(line, sep) + F.lit(len(sep))))
                 ).alias("v"),
        i.alias("i")))
    return F.filter(pairs, lambda p: p["v"].isNotNull() & (p["k"] != ""))


def kv_map(c, sep: str = "=") -> Column:
    """Text -> ``MAP<STRING,STRING>``; the last duplicate key wins (Python
    ``dict``).  Sorting by (key, line) and keeping the last of each key run is
    O(n log n) per text and never builds a map with duplicate keys."""
    def dedup(e):
        n = F.size(e)
        last = F.filter(e, lambda x, j: (j == n - 1) | (F.element_at(e, j + 2)["k"] != x["k"]))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))

    # sort by (key, line): the last entry of each key run is the last duplicate
    by_key_line = F.transform(kv_entries(c, sep), lambda x: F.struct(
        x["k"].alias("k"), x["i"].alias("i"), x["v"].alias("v")))
    return let(F.array_sort(by_key_line), dedup)


def kv_map_batches(c) -> Column:
    """T1 as ``kv_map``, over Arrow batches: a third of the time, but Spark forgets how
    the rows were dealt out, so it belongs in front of an exchange."""
    return F.arrow_udf(kv_maps, "map<string,string>").asNondeterministic()(col_of(c))


def kv_maps(texts: pa.Array) -> pa.Array:
    """T1 of a batch of texts; the keys of a map are sorted as in ``kv_map``."""
    ends, keys, values = [0], [], []
    for text in texts.to_pylist():
        found = {}
        for line in re.split("\r\n|\r|\n", text or ""):
            key, sep, value = line.partition("=")
            if sep and (key := key.strip()):
                found[key] = value.strip()
        for key in sorted(found):
            keys.append(key)
            values.append(found[key])
        ends.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def kv_table(df: DataFrame, text_col: str, keys: list[str], sep: str = "=") -> DataFrame:
    """T1 long form: one row per ``(keys..., key)`` with the last value of the key."""
    ex = df.select(*keys, F.explode(kv_entries(text_col, sep)).alias("e"))
    return (ex.groupBy(*keys, F.col("e.k").alias("key"))
              .agg(F.max_by(F.col("e.v"), F.col("e.i")).alias("value")))


def render_kv(m, keys: list[str], begin: str | None = None, end: str | None = None) -> Column:
    """Inverse of T1 for a fixed key list: one ``key=value`` line per present key."""
    mm = col_of(m)
    lines = [F.when(F.map_contains_key(mm, k), F.concat(F.lit(k + "="), mm[k])) for k in keys]
    body = F.concat_ws("\n", *lines)
    parts = ([F.lit(begin)] if begin else []) + [body] + ([F.lit(end)] if end else [])
    return F.concat_ws("\n", *parts)


# ------------------------------------------------------------ T2 crystal text

_DARK = "[^" + WS_CLASS[1:]


def with_crystal_record(df: DataFrame, text: str, name: str = "record", canonical: bool = False) -> DataFrame:
    """T2 over a DataFrame: adds the struct column ``name`` (see ``crystal_record``).

    ``canonical``: the same pass over the batches also makes the canonical text and the
    element counts, fields of the record that ``with_canonical`` then finds there.
    """
    if canonical:
        return df.withColumn(name, F.arrow_udf(canonical_records, MADE_DDL).asNondeterministic()(F.col(text)))
    return df.withColumn(name, crystal_record(text))


def crystal_record(c) -> Column:
    """Crystallographic text -> record struct, as one Column.

    Fields: name, formula_structural, formula_sum, cell_a/b/c, alpha/beta/gamma,
    z, sites ``ARRAY<STRUCT<element, x, y, z>>`` and parse_error (null when the
    record parsed).  Required: a ``data_`` block, the six cell values (finite numbers)
    and a positive integer Z; a site row with a bad number, or a site loop whose values
    do not fill its rows, fails the record.  Tags are read in any case, from the first
    ``data_`` block; values may be quoted, on the next line or in a ``;`` text field.
    Only the text goes to the Python worker and comes back as the record's columns.
    """
    # the mark keeps Spark from inlining the call into each use of the record
    return F.arrow_udf(records, RECORD_DDL).asNondeterministic()(col_of(c))


def site_table(df: DataFrame, keys: list[str], record_col: str = "record") -> DataFrame:
    """Long form of T2: ``(keys..., pos, element, x, y, z)``."""
    return (df.select(*keys, F.posexplode(F.col(record_col + ".sites")).alias("pos", "s"))
              .select(*keys, "pos", "s.element", "s.x", "s.y", "s.z"))


# ------------------------------------------------------------ A1 / A3


def element_counts(elements) -> Column:
    """A1 in-row: ``ARRAY<STRUCT<element, n>>`` in first-appearance order."""
    return let(col_of(elements), lambda els: F.transform(F.array_distinct(els), lambda e: F.struct(
        e.alias("element"), F.size(F.filter(els, lambda x: x == e)).cast("bigint").alias("n"))))


def schema_text(counts) -> Column:
    """A1 rendering: ``label:count`` joined with ``|``."""
    return F.array_join(F.transform(col_of(counts), lambda p: F.concat(
        p["element"], F.lit(":"), p["n"].cast("string"))), "|")


def count_schema(df: DataFrame, group, label: str, pos: str, name: str = "schema") -> DataFrame:
    """A1 as a distributed aggregate: per group ``label:count`` joined with ``|``
    in first-appearance order.  Partial aggregation runs map-side; the list per
    group has one entry per distinct label."""
    group = [group] if isinstance(group, str) else list(group)
    per_label = (df.groupBy(*group, label)
                   .agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_p")))
    return (per_label.groupBy(*group)
                     .agg(F.array_sort(F.collect_list(F.struct("_p", label, "_n"))).alias("_l"))
                     .select(*group, F.array_join(F.transform("_l", lambda x: F.concat(
                         x[label], F.lit(":"), x["_n"].cast("string"))), "|").alias(name)))


# ------------------------------------------------------------ T3 canonical text


def _fmt(x: Column) -> Column:
    return F.format_string("%.6f", x)


def quoted(v: Column) -> Column:
    """A value as it must stand to be read back whole: bare, in quotes or as a text field."""
    plain = v.rlike("^[^_#$'\"\\[\\];" + _DARK[2:] + _DARK + "*$") & ~v.rlike(
        "(?i)^(?:loop_|global_|stop_|data_|save_)")
    line = ~v.rlike(r"[\r\n]")
    return F.when(plain, v).when(line & ~v.contains("'"), F.concat(F.lit("'"), v, F.lit("'"))) \
            .when(line & ~v.contains('"'), F.concat(F.lit('"'), v, F.lit('"'))) \
            .otherwise(F.concat(F.lit("\n;"), v, F.lit("\n;")))


def site_lines(record) -> Column:
    """The rows of the site loop of a canonical text."""
    return F.transform(col_of(record)["sites"], lambda s: F.concat_ws(
        " ", s["element"], _fmt(s["x"]), _fmt(s["y"]), _fmt(s["z"])))


def canonical_text(record, counts=None, sites=None) -> Column:
    """T3 rendering: fixed tag order, six decimals, formula sum from the sites.

    ``counts`` (A1 of the sites) and ``sites`` (``site_lines``) may come from columns
    that already hold them.
    """
    r = col_of(record)
    if counts is None:
        counts = element_counts(F.transform(r["sites"], lambda s: s["element"]))
    sites = site_lines(record) if sites is None else col_of(sites)
    name = F.when(r["name"] == "", F.lit("unknown")).otherwise(r["name"])
    fs = F.coalesce(r["formula_structural"], F.lit(""))
    head = F.concat_ws(
        "\n", F.concat(F.lit("data_"), name),
        F.concat(F.lit("_chemical_formula_structural "), F.when(fs == "", F.lit("unknown")).otherwise(quoted(fs))),
        F.concat(F.lit("_chemical_formula_sum '"), counts_text(counts, " "), F.lit("'")),
        *[F.concat(F.lit(tag + " "), _fmt(r[field])) for tag, field in zip(
            CELL_TAGS, ("cell_a", "cell_b", "cell_c", "alpha", "beta", "gamma"))],
        F.concat(F.lit("_cell_formula_units_Z "), r["z"].cast("string")),
        F.lit("loop_\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z"))
    return F.when(F.size(sites) > 0, F.concat(head, F.lit("\n"), F.array_join(sites, "\n"))).otherwise(head)


# Degenerate-record markers; any of the first list, or all of the
# second list, marks a record as degenerate.
DEGENERATE_ANY = (
    "data_unknown",
    "_chemical_formula_structural unknown",
    "_chemical_formula_sum ''",
    '_chemical_formula_sum ""',
)
DEGENERATE_ALL = (
    "_cell_length_a 0.000000",
    "_cell_length_b 0.000000",
    "_cell_length_c 0.000000",
)


def contains_any(c, markers) -> Column:
    cc = col_of(c)
    out = F.lit(False)
    for m in markers:
        out = out | cc.contains(m)
    return out


def contains_all(c, markers) -> Column:
    cc = col_of(c)
    out = F.lit(True)
    for m in markers:
        out = out & cc.contains(m)
    return out


def degenerate(c, any_markers=DEGENERATE_ANY, all_markers=DEGENERATE_ALL) -> Column:
    """Plain substring test (a length printed 0.0000004 also matches)."""
    return F.coalesce(contains_any(c, any_markers) | contains_all(c, all_markers), F.lit(False))


def with_canonical(df: DataFrame, record: str, original: str) -> DataFrame:
    """T3 over a DataFrame with parsed records: adds cif, canonicalized,
    canonicalize_error and the record's element ``counts`` (A1), each computed once."""
    failed = F.col(record)["parse_error"].isNotNull()
    if "canonical" in df.schema[record].dataType.names:
        out = df.select("*", F.col(record)["counts"].alias("counts"), F.col(record)["canonical"].alias("_canon"))
    else:
        out = df.select("*", element_counts(F.transform(F.col(record)["sites"], lambda s: s["element"])).alias("counts"),
                        site_lines(record).alias("_lines"))
        out = out.select("*", canonical_text(record, F.col("counts"), F.col("_lines")).alias("_canon"))
    out = out.select("*", degenerate("_canon").alias("_deg"))
    return out.select(
        *df.columns, F.when(failed, F.col(original)).otherwise(F.col("_canon")).alias("cif"),
        (~failed & ~F.col("_deg")).alias("canonicalized"),
        F.when(failed, F.col(record)["parse_error"])
         .when(F.col("_deg"), F.lit("degenerate_canonicalized_cif")).alias("canonicalize_error"), "counts")


def canonicalize(c) -> Column:
    """``STRUCT<cif, canonicalized, canonicalize_error>``.

    Parse failure -> original text, not ok, the parse message; degenerate ->
    canonical text, not ok, ``degenerate_canonicalized_cif``.  A failed row is
    still verified on its own text by the job.
    """
    return canonicalize_record(crystal_record(c), c)


def canonicalize_record(rec, original) -> Column:
    """T3 on an already parsed record (``original`` is the text it came from)."""
    def build(r):
        failed = r["parse_error"].isNotNull()
        return let(canonical_text(r), lambda canon: F.struct(
            F.when(failed, col_of(original)).otherwise(canon).alias("cif"),
            (~failed & ~degenerate(canon)).alias("canonicalized"),
            F.when(failed, r["parse_error"])
             .when(degenerate(canon), F.lit("degenerate_canonicalized_cif"))
             .alias("canonicalize_error")))
    return materialize(let(col_of(rec), build))


# ------------------------------------------------------------ F19


def derive_full_fields(fields, formula, reduced=None) -> Column:
    """F19 (our definition; the compiler is absent from the reference tree):
    five fields from the core fields and the request formula.

    site_schema = reduced counts x Z rendered as A1; n_listed_sites = their sum;
    formula_sum_expected = counts x Z as text; geometry_signature_v4 and
    prototype_bucket_v4 = ``|``-joined core labels.  ``reduced`` holds the reduced counts
    of the formula where they are known already.
    """
    m = col_of(fields)
    reduced = reduced_counts(formula_counts(formula)) if reduced is None else col_of(reduced)
    z = int_text(F.coalesce(F.try_element_at(m, F.lit("output_Z_raw")), F.lit("")))
    def g(k):
        return F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))

    return let(scale_counts(reduced, z),
               lambda cell: _full_map(cell, z, g))


def _total(cell: Column) -> Column:
    """Sum of the counts; null when it does not fit."""
    return F.aggregate(cell, F.lit(0).cast("bigint"), lambda a, p: F.try_add(a, p["n"]))


def _full_map(cell: Column, z: Column, g) -> Column:
    return F.when(z.isNotNull() & (z > 0) & _total(cell).isNotNull(), F.create_map(
        F.lit("site_schema"), schema_text(cell),
        F.lit("n_listed_sites"), _total(cell).cast("string"),
        F.lit("formula_sum_expected"), counts_text(cell, " "),
        F.lit("geometry_signature_v4"), F.concat_ws("|", g("metric_family"), g("length_pattern"),
                                                    g("angle_pattern"), g("vol_per_atom_bin")),
        F.lit("prototype_bucket_v4"), F.concat_ws("|", g("reduced_ratio"), g("condition_sg_number"),
                                                  g("metric_family"), g("position_family"),
                                                  g("stack_family")),
    ))


def compile_full_text(core_text, derived) -> Column:
    """Full scaffold text: the core block with the derived ``key=value`` lines
    placed before its closing tag line (or appended when there is none)."""
    derived = col_of(derived)
    full_lines = render_kv(derived, ["site_schema", "n_listed_sites", "formula_sum_expected",
                                     "geometry_signature_v4", "prototype_bucket_v4"])
    t = strip_ws(col_of(core_text))
    last_nl = F.length(t) - F.locate("\n", F.reverse(t)) + 1
    has_nl = F.instr(t, "\n") > 0
    last_line = F.when(has_nl, F.call_function("substr", t, last_nl + 1)).otherwise(t)
    head = F.when(has_nl, F.call_function("substr", t, F.lit(1), last_nl - 1)).otherwise(F.lit(""))
    closing = ~last_line.contains("=") & last_line.startswith("<")
    return F.when(derived.isNotNull(), F.when(
        closing, F.concat_ws("\n", F.when(head != "", head), full_lines, last_line))
        .otherwise(F.concat_ws("\n", t, full_lines)))
