"""Golden cases of FIXTURES.md §3, one per rule, quirk and hazard."""

import csv
import io
import random
import json

import pytest
from pyspark.sql import functions as F

from cribra.functions import formula as fm
from cribra.functions import labels as lb
from cribra.functions import text as tx
from cribra.operators import lookup as lk
from cribra.operators import parse as ps
from cribra.operators import rules as rl
from cribra.operators import select as sl
from cribra.plans import jobs


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def col_values(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


# ---------------------------------------------------------------- F1 F2 D1 W2 D2

def test_whitespace_set_matches_python():
    assert tx.WS_CHARS == "".join(c for c in map(chr, range(0x3100)) if c.isspace())


def test_normalize_and_strip_like_python(spark):
    samples = [" a  b ", "\x1c x　y\xa0", "\t\n", "é ü "]
    norm = col_values(spark, samples, tx.normalize_ws)
    strip = col_values(spark, samples, tx.strip_ws)
    assert norm == [" ".join(s.split()) for s in samples]
    assert strip == [s.strip() for s in samples]


def test_dedupe_first_then_number(spark):
    resp = spark.createDataFrame([(0, 0, " a  b "), (0, 1, "a b"), (0, 2, ""), (0, 3, "c")],
                                 "row_id long, seq int, response string")
    out = jobs.prepare_responses(resp, 6).orderBy("rank").collect()
    assert [(r["rank"], r["response"]) for r in out] == [(0, "a  b"), (1, "c")]


def test_cap_after_dedupe(spark):
    resp = spark.createDataFrame([(0, i, t) for i, t in enumerate(["x", "x ", "y", "z"])],
                                 "row_id long, seq int, response string")
    out = jobs.prepare_responses(resp, 2).orderBy("rank").collect()
    assert [(r["rank"], r["response"]) for r in out] == [(0, "x"), (1, "y")]


def test_dedupe_keep_blank_keeps_rank_gaps(spark):
    df = spark.createDataFrame([(0, 0, "x"), (0, 1, ""), (0, 2, "x"), (0, 3, "")],
                               "g int, rank int, k string")
    out = sl.dedupe_first(df, "g", "k", "rank", keep_blank=True).orderBy("rank").collect()
    assert [r["rank"] for r in out] == [0, 1, 3]


# ---------------------------------------------------------------- P2 P1 L1

def test_parse_code_valid(spark):
    assert col_values(spark, ["225", "225.9", " 62 ", "1e2", "230.99"], rl.parse_code) == \
        [225, 225, 62, 100, 230]


def test_parse_code_invalid(spark):
    bad = ["0", "0.99", "231", "nan", "inf", "abc", "12d", ""]
    assert col_values(spark, bad, rl.parse_code) == [None] * len(bad)


def test_request_errors_carry_record_number(spark):
    df = spark.createDataFrame([(0, "mp-1", "NaCl", "225"), (1, " ", "NaCl", "1"),
                                (2, "mp-3", "  ", "1")],
                               "row_id long, material_id string, pretty_formula string, space_group string")
    with pytest.raises(jobs.RequestError, match="CSV line 3"):
        jobs.split_requests(df)
    good, bad = jobs.split_requests(df, on_error="quarantine")
    assert good.count() == 1
    assert sorted(r["row_error"] for r in bad.collect()) == [
        "Empty material_id or pretty_formula at CSV line 3",
        "Empty material_id or pretty_formula at CSV line 4"]


def test_first_n_skips_later_bad_rows(spark):
    df = spark.createDataFrame([(0, "a", "NaCl", "1"), (1, "b", "NaCl", "2"), (2, "", "", "x")],
                               "row_id long, material_id string, pretty_formula string, space_group string")
    good, _ = jobs.split_requests(sl.first_n(df, 2))
    assert good.count() == 2
    with pytest.raises(ValueError):
        sl.first_n(df, 0)


# ---------------------------------------------------------------- F3 F4 F8 F20 F17

def test_tagged_block(spark):
    b, e = "<B>", "</B>"
    vals = ["zz <B>in</B> yy <B>q</B>", " no end <B> x ", "x </B> y <B> z"]
    assert col_values(spark, vals, lambda c: tx.tagged_block(c, b, e)) == \
        ["<B>in</B>", "no end <B> x", None]
    assert col_values(spark, vals, lambda c: tx.tagged_block_error(c, b, e)) == \
        [None, None, "bad_tag_order"]


def test_cut_from_marker(spark):
    assert one(spark, tx.cut_from_marker(F.col("v")), "ok data_x ... </s>") == "data_x ..."


def test_safe_stem(spark):
    assert col_values(spark, [" a/b:c. ", "...", "mp-1"], tx.safe_stem) == ["a_b_c", "sample", "mp-1"]


def test_token_budget(spark):
    df = spark.createDataFrame([(100,), (1500,), (1520,)], "p int")
    out = df.select(tx.token_budget("p", F.lit(1536), F.lit(192)).alias("b"),
                    tx.token_budget_error("p", F.lit(1536)).alias("e")).collect()
    assert [(r["b"], r["e"]) for r in out] == [(192, None), (20, None), (None, "prompt_too_long")]


def test_json_list_matches_python(spark):
    items = ["a", 'q"r', "é\n", "back\\slash", "tab\t"]
    df = spark.createDataFrame([(items,)], "a array<string>")
    assert df.select(tx.json_list("a")).first()[0] == json.dumps(items, ensure_ascii=False)


# ---------------------------------------------------------------- F11 A2 F12 F13

def test_formula_counts_and_gcd(spark):
    vals = ["NaCl", "Fe2O3", "C6H12O6", "Na2Na4Cl6"]
    counts = col_values(spark, vals, fm.formula_counts)
    assert [[(x["element"], x["n"]) for x in c] for c in counts] == [
        [("Na", 1), ("Cl", 1)], [("Fe", 2), ("O", 3)], [("C", 6), ("H", 12), ("O", 6)],
        [("Na", 6), ("Cl", 6)]]
    assert col_values(spark, vals, lambda c: fm.counts_gcd(fm.formula_counts(c))) == [1, 1, 6, 6]
    assert col_values(spark, vals, fm.formula_ratio) == ["1:1", "2:3", "1:2:1", "1:1"]


def test_formula_invalid(spark):
    bad = ["Ca(OH", "CaOH)2", "Ca(OH]2", "Ca()2", "Ca(2H)", "Li.5", "Li5.", "Na0Cl", "Na(Cl)0", "Na0.0Cl", "Na05(Cl)",
           "xx", "", "H2O\u00b7", "\u00b7H2O", "C\u00b7o2", "Ca(OH\u00b7H2O)2", "2H2O", "<OH>2",
           "A(B9223372036854775807)2"]
    assert col_values(spark, bad, fm.formula_counts) == [None] * len(bad)


def test_formula_groups_dots_and_decimals(spark):
    texts = {"Ca(OH)2": "Ca1O2H2", "[Co(NH3)6]Cl3": "Co1N6H18Cl3", "CuSO4\u00b75H2O": "Cu1S1O9H10",
             "CaSO4 * 0.5 H2O": "Ca10S10O45H10", "Li0.5CoO2": "Li5Co10O20", "Li0.50(Mg0.5O)1.5": "Li50Mg75O150",
             "((((H))))2": "H2", "{Na}2.0": "Na2", "Na" + "(C)2" * 3000: "Na1C6000"}
    got = col_values(spark, list(texts), lambda c: fm.counts_text(fm.formula_counts(c)))
    assert got == list(texts.values())


def test_gcd_large_values(spark):
    df = spark.createDataFrame([(1134903170, 1836311903), (2 ** 40 * 3, 2 ** 41 * 5)],
                               "a long, b long")
    assert [r[0] for r in df.select(fm.gcd2(F.col("a"), F.col("b"))).collect()] == [1, 2 ** 40]


def test_reduced_equality(spark):
    df = spark.createDataFrame([("Na Cl", "NaCl"), ("Na2Cl2", "ClNa"), ("NaCl2", "NaCl"),
                                ("xx", "xx")], "a string, b string")
    out = df.select(fm.same_reduced(fm.formula_counts("a"), fm.formula_counts("b"))).collect()
    assert [r[0] for r in out] == [True, True, False, False]


# ---------------------------------------------------------------- P3-P6

FULL = {"formula": "NaCl", "reduced_ratio": "1:1", "condition_sg_number": "225",
        "condition_crystal_system": "cubic", "target_cell_mode": "primitive",
        "output_Z_raw": "4", "metric_family": "M", "length_pattern": "ALL_EQ",
        "angle_pattern": "ALL_EQ", "vol_per_atom_bin": "V1", "position_family": "HIGH_SPECIAL",
        "stack_family": "NO_LAYER"}


def check(spark, fields, formula="NaCl", sg=225, full=False):
    df = spark.createDataFrame([(fields, formula, sg)], "m map<string,string>, f string, sg int")
    r = df.select(rl.check_scaffold("m", "f", "sg", full).alias("c")).first()["c"]
    return r["valid"], r["errors"]


def test_empty_scaffold(spark):
    assert check(spark, {}) == (False, ["empty_scaffold"])


def test_valid_core_and_whitespace_formula(spark):
    assert check(spark, dict(FULL, formula="Na Cl")) == (True, [])


def test_missing_and_bad_z(spark):
    m = dict(FULL)
    del m["output_Z_raw"]
    assert check(spark, m) == (False, ["missing_output_Z_raw", "bad_output_Z_raw"])
    for z in ("4.0", "-1", "0"):
        assert check(spark, dict(FULL, output_Z_raw=z)) == (False, ["bad_output_Z_raw"])


def test_full_rules(spark):
    ok, errs = check(spark, FULL, full=True)
    assert not ok and errs[:2] == ["missing_site_schema", "missing_n_listed_sites"]


# ---------------------------------------------------------------- P7 A1 P11 P12

def test_degenerate(spark):
    base = "_cell_length_a 0.000000\n_cell_length_b 0.000000\n"
    vals = ["data_unknown", base, base + "_cell_length_c 0.0000004", "data_x"]
    assert col_values(spark, vals, ps.degenerate) == [True, False, True, False]


def test_count_schema_first_appearance(spark):
    df = spark.createDataFrame([(["Na", "Cl", "Na"],)], "e array<string>")
    assert df.select(ps.schema_text(ps.element_counts("e"))).first()[0] == "Na:2|Cl:1"
    long = spark.createDataFrame([(0, 0, "Na"), (0, 1, "Cl"), (0, 2, "Na")], "g int, pos int, el string")
    assert ps.count_schema(long, "g", "el", "pos").first()["schema"] == "Na:2|Cl:1"


def test_penalty(spark):
    df = spark.createDataFrame([("GENERAL_DOMINANT", "NO_LAYER", "HIGH_SPECIAL", "LAYERED_X"),
                                ("MIXED_SPECIAL", "SKEW_DIAGONAL", "HIGH_SPECIAL", "NO_LAYER")],
                               "ep string, es string, p string, s string")
    out = df.select(rl.collapse_penalty("ep", "es", "p", "s")).collect()
    assert [r[0] for r in out] == [4, 2]


def test_weighted_score(spark):
    df = spark.createDataFrame([(["zero_lattice", "a_mismatch", "b_mismatch"], 2)],
                               "e array<string>, p int")
    assert df.select(rl.weighted_score("e", "p")).first()[0] == 100 - 12 - 10 - 12


# ---------------------------------------------------------------- P13 P10 via the job

CIF = """data_NaCl
_chemical_formula_structural NaCl
_cell_length_a 5.64
_cell_length_b 5.64
_cell_length_c 5.64
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
_cell_formula_units_Z 4
loop_
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
""" + "\n".join(f"{e} 0.{i} 0.0 0.0" for i, e in enumerate(["Na", "Cl"] * 4))


def scaffold_text(**over):
    m = dict(FULL, site_schema="Na:4|Cl:4", n_listed_sites="8", formula_sum_expected="Na4 Cl4",
             geometry_signature_v4="g", prototype_bucket_v4="b", vol_per_atom_bin="V3",
             position_family="GENERAL_DOMINANT", metric_family="M1")
    m.update(over)
    return "\n".join(f"{k}={v}" for k, v in m.items() if v is not None)


def crystal_candidates(spark, scaffold, texts, labels=("M1", "GENERAL_DOMINANT", "NO_LAYER")):
    req = spark.createDataFrame([(0, "mp-1", "NaCl", 225, scaffold)],
                                "row_id long, material_id string, pretty_formula string, "
                                "space_group int, scaffold_full string")
    resp = spark.createDataFrame([(0, i, t, *labels) for i, t in enumerate(texts)],
                                 "row_id long, seq int, response string, metric_family string, "
                                 "position_family string, stack_family string")
    return jobs.crystal_candidates(req, resp, len(texts)).orderBy("order_no").collect()


def test_verify_valid_record(spark):
    c = crystal_candidates(spark, scaffold_text(), [CIF])[0]
    assert c["verify_errors"] == [] and c["consistency_score"] == 100 and c["valid_cif"]


def test_verify_invalid_scaffold(spark):
    c = crystal_candidates(spark, scaffold_text(site_schema=None), [CIF])[0]
    assert c["verify_errors"] == ["invalid_scaffold:missing_site_schema"]
    assert (c["consistency_score"], c["collapse_penalty"]) == (-999, 999)


def test_verify_parse_failure(spark):
    c = crystal_candidates(spark, scaffold_text(), ["data_x\n_cell_length_a 1"])[0]
    assert c["verify_errors"][0].startswith("parse_failed:")
    assert (c["consistency_score"], c["collapse_penalty"], c["cif_fields"]) == (-999, 999, None)


def test_optional_rules_presence(spark):
    c = crystal_candidates(spark, scaffold_text(eq_angle_bin="A2"), [CIF])[0]
    assert c["verify_errors"] == ["eq_angle_bin_mismatch"]   # ALL_EQ pattern -> actual ''
    c = crystal_candidates(spark, scaffold_text(), [CIF])[0]
    assert "gamma_bin_mismatch" not in c["verify_errors"]


def test_cif_ranking_stable_ties(spark):
    df = spark.createDataFrame([(0, r, True, 100, 0, True) for r in (2, 0, 1)],
                               "row_id long, rank int, valid_cif boolean, consistency_score int, "
                               "collapse_penalty int, canonicalized boolean")
    out = sl.rank_candidates(df, "row_id", jobs.cif_ranking()).orderBy("order_no").collect()
    assert [r["rank"] for r in out] == [0, 1, 2]


def test_scaffold_ranking_fewer_errors_first(spark):
    df = spark.createDataFrame([(0, 0, False, ["a", "b", "c"], {}, ""), (0, 1, False, ["a"], {}, "")],
                               "row_id long, rank int, valid_scaffold boolean, scaffold_errors array<string>, "
                               "fields map<string,string>, scaffold_full string")
    out = sl.rank_candidates(df, "row_id", jobs.scaffold_ranking()).orderBy("order_no").collect()
    assert [r["rank"] for r in out] == [1, 0]


# ---------------------------------------------------------------- J1 J4

def test_ladder_top_k_distinct(spark):
    index = spark.createDataFrame(
        [("level1", "k1", 0, "a"), ("level2", "k2", 0, "a"), ("level2", "k2", 1, "b"),
         ("level3", "k3", 0, "c"), ("level3", "k3", 1, "d")], "level string, key string, pos int, hint string")
    reqs = spark.createDataFrame([(0, "k1", "k2", "k3"), (1, "x", "y", "z")],
                                 "row_id long, a string, b string, c string")
    reqs = reqs.select("row_id", F.array(*[F.struct(F.lit(lv).alias("level"), F.col(c).alias("key"))
                                           for lv, c in (("level1", "a"), ("level2", "b"), ("level3", "c"))])
                       .alias("keys"))
    hits = lk.ladder_join(reqs, "keys", index, F.col("hint"), "hint", k=3)
    assert [r["hint"] for r in hits.orderBy("hint_no").collect()] == ["a", "b", "c"]
    blocks = lk.hint_block(hits, "hint")
    out = {r["row_id"]: r["hints"] for r in lk.attach_hints(reqs, blocks=blocks).collect()}
    assert out[1] == ""
    assert out[0] == "\n".join(["<PROTOTYPE_HINTS_V4>", "[hint_0]", "a", "[hint_1]", "b",
                                "[hint_2]", "c", "</PROTOTYPE_HINTS_V4>"])
    const = lk.attach_hints(reqs, hint_text=" fixed ", blocks=blocks)
    assert {r["hints"] for r in const.collect()} == {"fixed"}


def test_index_reader_object_layout(spark, tmp_path):
    p = tmp_path / "index.json"
    p.write_text(json.dumps({"level1": {"k": [{"scaffold_full": " s1 "}, {"scaffold_full": "s2", "b": 1.0}]}},
                            indent=2))
    idx = lk.read_index(spark, str(p)).select("level", "key", "pos", lk.row_text(F.col("row")).alias("t"))
    assert [(r["level"], r["key"], r["pos"], r["t"]) for r in idx.orderBy("pos").collect()] == [
        ("level1", "k", 0, "s1"), ("level1", "k", 1, "s2")]


# ---------------------------------------------------------------- P16 S4 S6 Q1/Q2

def test_routing_outcomes(spark):
    req = spark.createDataFrame(
        [(0, "a", "NaCl", 225, ""), (1, "b", "NaCl", 225, scaffold_text()),
         (2, "c", "NaCl", 225, scaffold_text()), (3, "d", "NaCl", 225, scaffold_text()),
         (4, "d", "NaCl", 225, scaffold_text())],
        "row_id long, material_id string, pretty_formula string, space_group int, scaffold_full string")
    resp = spark.createDataFrame(
        [(2, 0, "data_x\n_cell_length_a 1", "M1", "GENERAL_DOMINANT", "NO_LAYER"),
         (3, 0, CIF, "M1", "GENERAL_DOMINANT", "NO_LAYER"),
         (4, 0, CIF, "M1", "GENERAL_DOMINANT", "NO_LAYER")],
        "row_id long, seq int, response string, metric_family string, position_family string, stack_family string")
    out = {r["row_id"]: r for r in jobs.crystal_job(req, resp, 1, strict=True, out_dir="o").collect()}
    assert [out[i]["outcome"] for i in range(5)] == [
        "missing_scaffold_full", "generation_failed", "no_valid_cif_candidate", "success", "success"]
    rej = out[2]
    assert rej["cif_path"] == "" and rej["selected_rank"] == "0"
    assert out[1]["verify_errors"] == '["generation_failed"]'
    assert out[3]["cif_path"] == out[4]["cif_path"] == "o/d.cif"   # duplicate ids: two rows


def test_csv_round_trip(spark, tmp_path):
    from cribra.sources.io import read_requests, write_results
    vals = ['q"r', "two\nlines", "a,b", "back\\slash", "  lead", ""]
    df = spark.createDataFrame([(i, v, "NaCl", "1") for i, v in enumerate(vals)],
                               "row_id long, material_id string, pretty_formula string, space_group string")
    path = str(tmp_path / "out")
    write_results(df, path, ["row_id", "material_id", "pretty_formula"], single_file=True)
    part = [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".csv")][0]
    rows = list(csv.DictReader(io.StringIO(part.read_text(encoding="utf-8"))))
    assert [r["material_id"] for r in rows] == vals
    back = read_requests(spark, path, ["row_id", "material_id"], ordinal="pos")
    assert [r["material_id"] or "" for r in back.orderBy("pos").collect()] == vals
    assert [r["pos"] for r in back.orderBy("pos").collect()] == list(range(len(vals)))


def test_stem_collisions(spark):
    from cribra.sources.io import text_files
    df = spark.createDataFrame([(0, "a/b", "x"), (1, "a:b", "y")], "row_id long, id string, t string")
    out = text_files(df, "id", "t", "/out").orderBy("row_id").collect()
    assert [r["stem"] for r in out] == ["a_b", "a_b"]
    assert [r["n_same_stem"] for r in out] == [2, 2] and [r["kept"] for r in out] == [False, True]


def test_scaffold_job_every_request_one_row(spark):
    req = spark.createDataFrame([(0, "m", "NaCl", 225), (1, "m", "NaCl", 225)],
                                "row_id long, material_id string, pretty_formula string, space_group int")
    resp = spark.createDataFrame([(0, 0, "junk")], "row_id long, seq int, response string")
    out = {r["row_id"]: r for r in jobs.scaffold_job(req, resp, 6).collect()}
    assert len(out) == 2
    assert out[1]["scaffold_errors"] == '["generation_failed"]'
    assert out[0]["scaffold_errors"] == '["empty_scaffold"]' and out[0]["valid_scaffold"] == "False"


# ---------------------------------------------------------------- U1

def test_generate_hook_errors_become_rows(spark):
    from cribra.operators.generate import generate

    def factory():
        def gen(prompts, n):
            if any("boom" in p for p in prompts):
                raise RuntimeError("model failed")
            return [[p + str(i) for i in range(n)] for p in prompts]
        return gen

    ok = spark.createDataFrame([(0, " hi ")], "row_id long, prompt string")
    rows = generate(ok, factory, 2).orderBy("seq").collect()
    assert [(r["seq"], r["response"], r["error"]) for r in rows] == [(0, "hi 0", None), (1, "hi 1", None)]
    bad = spark.createDataFrame([(0, "boom")], "row_id long, prompt string")
    r = generate(bad, factory, 2).collect()
    assert len(r) == 1 and "model failed" in r[0]["error"]


# ---------------------------------------------------------------- end to end

def test_crystal_batch_end_to_end(spark, tmp_path):
    from cribra.plans.batch import load_hint_text, run_crystal_batch
    rows = [("mp-1", "NaCl", "225", scaffold_text()), ("mp/2", "NaCl", "225.5", scaffold_text()),
            ("mp-3", "NaCl", "225", "")]
    inp = tmp_path / "in.csv"
    with open(inp, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(["material_id", "pretty_formula", "space_group", "scaffold_full", "extra"])
        for r in rows:
            w.writerow([*r, "x"])
    resp = spark.createDataFrame(
        [(0, 0, CIF, "M1", "GENERAL_DOMINANT", "NO_LAYER"), (1, 0, "no record", "", "", "")],
        "row_id long, seq int, response string, metric_family string, position_family string, "
        "stack_family string")
    out_csv, out_dir = str(tmp_path / "out"), str(tmp_path / "cif")
    counts = run_crystal_batch(spark, str(inp), out_csv, out_dir, responses=resp, single_file=True)
    assert counts["written"] == 3 and counts["accepted"] == 2 and counts["stem_collisions"] == 0
    part = [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".csv")][0]
    got = list(csv.DictReader(io.StringIO(part.read_text(encoding="utf-8"))))
    assert [r["material_id"] for r in got] == ["mp-1", "mp/2", "mp-3"]
    assert got[2]["verify_errors"] == '["missing_scaffold_full"]'
    assert (tmp_path / "cif" / "mp-1.cif").read_text(encoding="utf-8").endswith("\n")
    assert (tmp_path / "cif" / "mp_2.cif").exists()
    hint = tmp_path / "hint.txt"
    hint.write_text("  use rock salt \n", encoding="utf-8")
    assert load_hint_text(spark, str(hint)) == "use rock salt"


CELL = ("_cell_length_a 1.0\n_cell_length_b 2(1)\n_cell_length_c 3\n_cell_angle_alpha 90\n"
        "_cell_angle_beta 90\n_cell_angle_gamma 90\n")


@pytest.mark.parametrize("n", [0, 1, 1000, 50000])
def test_t2_any_number_of_sites(spark, n):
    text = ("data_x\n_chemical_formula_structural 'Na Cl'\n" + CELL + "_cell_formula_units_Z 0000000004\n"
            "loop_\n_symmetry_x\n'x'\nloop_\n _atom_site_type_symbol\n_atom_site_fract_x\n"
            "_atom_site_fract_y\n_atom_site_fract_z\n" + "Na 0 0.5 0\n" * n + "_other 1\nNa 9 9 9\n")
    r = spark.createDataFrame([(text,)], "t string").select(ps.crystal_record("t").alias("r")).first().r
    assert (r.name, r.formula_structural, r.cell_b, r.z, r.parse_error) == ("x", "Na Cl", 2.0, 4, None)
    assert len(r.sites) == n and (n == 0 or r.sites[-1].y == 0.5)


SITES = ("loop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n"
         "_atom_site_fract_z\n")


def test_t2_token_forms(spark):
    head = "data_x\n" + CELL + "_cell_formula_units_Z 4\n"
    texts = {
        "quoted label": (head + SITES + "'Na 1' Na 0 0 0\n\"Cl '1'\" Cl .5 .5 .5\n", 2, None),
        "row over lines": (head + SITES + "Na1 Na 0\n 0 0\nCl1 Cl .5 .5 .5\n", 2, None),
        "tag in a text field": ("data_x\n_n\n;\n_cell_length_a 9\nloop_\n;\n" + CELL + "_cell_formula_units_Z 4\n", 0, None),
        "any case, next line": (head.upper().replace("DATA_X", "data_x").replace("_B ", "_B\n\n"), 0, None),
        "comments": (head.replace("\n", " # c 'x\n") + SITES + "# none\nNa1 Na 0 0 0 # _x 1", 1, None),
        "values left over": (head + SITES + "Na1 Na 0 0 0 Cl1\n", 0, "bad _atom_site_ row"),
        "tag in a loop": (head.replace("_cell_length_a", "loop_\n_cell_length_a"), 0, "bad _cell_length_a"),
        "second block": (head.replace("_cell_length_b", "_other_b") + "data_y\n" + CELL, 0, "bad _cell_length_b"),
        "aniso first": (head + "loop_\n_atom_site_aniso_label\n_atom_site_aniso_U_11\nNa 1\n" + SITES + "a Na 0 0 0", 1, None),
        "open text field": (head + "_n\n;\n" + CELL, 0, None),
    }
    df = spark.createDataFrame([(k, t[0]) for k, t in texts.items()], "k string, t string")
    flat = {r.k: r for r in ps.with_crystal_record(df, "t", "r").collect()}
    for r in df.select("k", ps.crystal_record("t").alias("r")).collect():
        assert r.r == flat[r.k].r, r.k
        assert (len(r.r.sites), r.r.parse_error) == texts[r.k][1:], r.k
        assert r.r.cell_a == 1.0 or "cell_length_a" in (r.r.parse_error or ""), r.k


def test_t2_is_one_pass_over_arrow_batches(spark):
    df = spark.createDataFrame([("data_x\n" + CELL,), (None,)], "t string")
    out = ps.with_canonical(ps.with_crystal_record(df, "t", "r"), "r", "t").select("r.cell_a", "r.z", "cif")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    assert [(r.cell_a, r.z) for r in out.collect()] == [(1.0, None), (None, None)]


def test_white_space_runs(spark):
    from cribra.functions.text import WS_CHARS, normalize_ws, remove_ws
    text = "".join(f"{chr(0x21 + i)}{c}{c}" for i, c in enumerate(WS_CHARS)) + "~\x7f\u200b\u00e9"
    r = spark.createDataFrame([(text,)], "t string").select(normalize_ws("t").alias("n"), remove_ws("t").alias("x")).first()
    assert r.n == " ".join(text.split()) and r.x == "".join(text.split())


def test_canonical_text_reads_back(spark):
    values = ["Na Cl", "it's", "a 'b' \"c\" d", "two\nlines", "_tag", "loop_", "#x", "plain(2)", "data_1", "'"]
    rows = [(f"data_x\n_chemical_formula_structural\n;{v}\n;\n" + CELL + "_cell_formula_units_Z 4\n" + SITES
             + "a Na 0 0.125 1e-3",) for v in values]
    df = ps.with_crystal_record(spark.createDataFrame(rows, "t string"), "t", "r")
    out = ps.with_crystal_record(ps.with_canonical(df, "r", "t"), "cif", "again").collect()
    assert [r.again.formula_structural for r in out] == values
    assert all(r.again.sites == r.r.sites and r.again.parse_error is None for r in out)


def test_f11_long_and_overflowing(spark):
    big = "9223372036854775807"
    texts = ["NaCl" * 12500, "Na" + "9" * 20 + "Cl", f"Na{big}Na{big}", "Na01", f"Na{big}", "Na Cl\n"]
    df = spark.createDataFrame([(t,) for t in texts], "f string")
    z = F.create_map(F.lit("output_Z_raw"), F.lit("9999999999"))
    rows = df.select(fm.formula_ratio("f").alias("r"),
                     ps.derive_full_fields(z, "f").alias("d")).collect()
    assert [r.r for r in rows] == ["1:1", None, None, None, "1", "1:1"]
    assert rows[0].d["n_listed_sites"] == "19999999998" and rows[1].d is None
    over = F.create_map(F.lit("output_Z_raw"), F.lit(big))
    assert df.select(ps.derive_full_fields(over, F.lit("Na2Cl3")).alias("d")).first().d is None


# ---------------------------------------------------------------- generators, order, strict forms

def _factory(tag):
    def factory():
        def gen(prompts, n):
            if any("boom" in p for p in prompts):
                raise RuntimeError("model failed")
            if any("short" in p for p in prompts):
                return [[tag]]
            return [[f"{tag}:{p}{i}" for i in range(n)] for p in prompts]
        return gen
    return factory


def test_generators_of_one_name_do_not_meet(spark):
    from cribra.operators.generate import generate
    df = spark.createDataFrame([(0, "p")], "row_id long, prompt string").coalesce(1)
    got = [generate(df, _factory(t), 1).first()["response"] for t in "ABC"]
    assert got == ["A:p0", "B:p0", "C:p0"]


def test_a_failing_prompt_fails_alone(spark):
    from cribra.functions.text import token_budget_error
    from cribra.operators.generate import generate
    rows = [(0, "x"), (1, "boom"), (2, "y"), (3, "short"), (4, "z" * 99)]
    df = spark.createDataFrame(rows, "row_id long, prompt string").coalesce(1)
    out = generate(df, _factory("A"), 2, partition=False,
                   prompt_error=token_budget_error(F.length("prompt"), F.lit(100))).collect()
    by = {}
    for r in out:
        by.setdefault(r["row_id"], []).append((r["response"], r["error"]))
    assert len(by[0]) == len(by[2]) == 2 and by[1] == [(None, "RuntimeError: model failed")]
    assert by[3] == [("A", None)]  # one list for one prompt is what was asked for
    assert by[4] == [(None, "prompt_too_long")]
    req = spark.createDataFrame([(i, "m", "NaCl", 1) for i in range(5)],
                                "row_id long, material_id string, pretty_formula string, space_group int")
    res = {r["row_id"]: r["scaffold_errors"] for r in jobs.scaffold_job(req, generate(
        df, _factory("A"), 2, partition=False), 2).collect()}
    assert res[1] == '["generation_failed", "generation_failed:RuntimeError: model failed"]'


def test_rows_of_many_files_are_numbered_in_file_order(spark, tmp_path):
    from cribra.sources.io import read_requests, write_results
    for name, n in (("a", 2), ("b", 3000), ("c", 50)):
        lines = "".join(f"{name}{i}\n" for i in range(n))
        (tmp_path / f"{name}.csv").write_text("id\n" + lines)
    back = read_requests(spark, str(tmp_path), ["id"])
    got = [r["id"] for r in back.orderBy("row_id").collect()]
    assert got == [f"{x}{i}" for x, n in (("a", 2), ("b", 3000), ("c", 50)) for i in range(n)]
    assert back.agg(F.max("row_id")).first()[0] == 3051
    df = spark.range(999, -1, -1, 7).select(F.col("id").alias("row_id"))
    write_results(df, str(tmp_path / "one"), ["row_id"], single_file=True)
    part = [p for p in (tmp_path / "one").iterdir() if p.name.endswith(".csv")]
    assert part[0].read_text().split() == ["row_id"] + [str(i) for i in range(1000)] and len(part) == 1


CSV_VALUES = ["plain", "", 'q"uote', "a,b", "two\nlines", "\n", "cr\r\nlf", '"', '""', "\u00e9\U0001f600", " pad ",
              '5" pipe', 'a\n"b"\n,c', ",", '"\n"', "x" * 300]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_csv_is_read_alike_in_any_number_of_splits(spark, tmp_path, end, split):
    from cribra.sources.io import read_requests
    rng = random.Random(split)
    path = tmp_path / "in.csv"
    rows = [r for r in ([rng.choice(CSV_VALUES) for _ in range(3)] for _ in range(250)) if any(r)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["a", "b", "c"])
        out.writerows(rows)
        f.write(end + end + 'un"quoted,5" x,t' + end + "short" + end + "1,2,3,4" + end + '"open,\n1,2')
    with open(path, newline="", encoding="utf-8") as f:
        want = [(r + ["", ""])[:3] for r in list(csv.reader(f))[1:] if r]
    got = read_requests(spark, str(path), ["c", "a", "b"], split_bytes=split).orderBy("row_id").collect()
    assert [[r.a or "", r.b or "", r.c or ""] for r in got] == want
    assert [r.row_id for r in got] == list(range(len(want)))


def test_first_rows_read_only_the_files_that_hold_them(spark, tmp_path):
    from cribra.sources import io, records
    for i in range(6):
        text = "id,x\n" + "".join(f'"{i}\n{j}",{j}\n' for j in range(10))
        (tmp_path / f"f{i}.csv").write_text(text if i < 4 else "id,x\n" + '"broken' * 3)
    read = []
    table = records.line_table
    records.line_table = lambda s, paths, sep: read.append(len(paths)) or table(s, paths, sep)
    try:
        got = io.read_requests(spark, str(tmp_path), ["id"], first_n=10).orderBy("row_id").collect()
        assert [r.id for r in got] == [f"0\n{j}" for j in range(10)] and read == [1]
        read.clear()
        assert io.read_requests(spark, str(tmp_path), ["id"], first_n=25).count() == 25 and read == [1, 2, 4]
    finally:
        records.line_table = table
    with pytest.raises(ValueError, match="Missing columns"):
        io.read_requests(spark, str(tmp_path / "f0.csv"), ["id", "y"])
    (tmp_path / "other.csv").write_text("x,id\n1,2\n")
    with pytest.raises(ValueError, match="Headers differ"):
        io.read_requests(spark, str(tmp_path), ["id"])


def test_requests_are_scanned_once_and_the_first_error_raises(spark, tmp_path):
    from cribra.plans.batch import run_scaffold_batch
    path = tmp_path / "in.csv"
    path.write_text("material_id,pretty_formula,space_group\nm,NaCl,225\n,NaCl,1\nk,NaCl,999\n")
    resp = spark.createDataFrame([(0, 0, "x")], "row_id long, seq int, response string")
    with pytest.raises(jobs.RequestError, match="CSV line 3"):
        run_scaffold_batch(spark, str(path), str(tmp_path / "out"), responses=resp)
    assert not (tmp_path / "out").exists()
    assert run_scaffold_batch(spark, str(path), str(tmp_path / "out"), responses=resp, first_n=1) == {"written": 1}
    path.write_text("material_id,pretty_formula,space_group\n")
    with pytest.raises(ValueError, match="No rows"):
        run_scaffold_batch(spark, str(path), str(tmp_path / "out2"), responses=resp)


def test_best_and_all_starts_from_the_requests(spark):
    cands = spark.createDataFrame([(0, 1, 5, False), (0, 2, 6, True)],
                                  "row_id long, order_no int, rank int, valid_cif boolean")
    req = spark.createDataFrame([(0,), (1,)], "row_id long")
    out = jobs.best_and_all(cands, ["rank", "valid_cif"], False, req, strict=True).orderBy("row_id").collect()
    assert [r["error"] for r in out] == ["no_valid_cif_candidate"] * 2
    assert out[0]["best"]["rank"] == 5 and out[1]["best"] is None and out[1]["all"] == []
    with pytest.raises(Exception, match="No candidate was generated"):
        jobs.best_and_all(cands, ["rank"], True, req).collect()


def test_truncated_index_fails(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"level1": {"k": [{"scaffold_full"')
    with pytest.raises(Exception, match="must be a JSON object"):
        lk.read_index(spark, str(tmp_path / "i.json")).collect()


def _json_text(rng):
    return "".join(rng.choice(["a", "}", "{", "[", "]", '"', "\\", '\\"', "},{", "\u00e9\U0001f600", "\n", "k:[{", '":[{"', ""])
                   for _ in range(rng.randint(0, 4)))


def _json_value(rng, depth=0):
    kind = rng.random() if depth < 2 else 1
    if kind < .2:
        return {_json_text(rng) + str(i): _json_value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    if kind < .4:
        return [_json_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([_json_text(rng), 1, 2.5, None, True])


@pytest.mark.parametrize("seed,split", [(1, 29), (2, 64), (3, 1 << 20), (4, 200)])
def test_an_index_of_one_object_in_many_splits(spark, tmp_path, seed, split):
    rng = random.Random(seed)
    want, place = [], {}
    for name in ("a", "b", "c"):  # lists of one key follow each other by file name
        doc = {level: {("shared" if not j else _json_text(rng) + f"k{j}"): [
            {"x": _json_value(rng), "i": i} if i % 3 else {} for i in range(rng.choice([0, 1, 2, 9]))]
            for j in range(rng.randint(0, 5))} for level in ("level1", 'le}v"el2', "level3")[:rng.randint(0, 3)]}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=rng.choice([None, 1]),
                                               ensure_ascii=rng.random() < .5) + rng.choice(["", " \n"]), encoding="utf-8")
        for level, keys in doc.items():
            for key, rows in keys.items():
                for row in rows:
                    at = place.get((level, key), 0)
                    place[level, key] = at + 1
                    want.append((level, key, at, json.dumps(row, sort_keys=True)))
    got = lk.read_index(spark, str(tmp_path), split_bytes=split).select("level", "key", "pos", F.to_json("row").alias("j"))
    assert sorted((r.level, r.key, r.pos, json.dumps(json.loads(r.j), sort_keys=True)) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("text", ['{"a":{"k":[1]}}', '{"a":5}', "[]", '{"a":{"k":["x"]}}', '{"a":{"k":[{}]}', '{"a":{"k":[{"x":1',
                                  '{"a":{"k":[{}]}}}', '{"a":{"k":[{} {}]}}', "x", '{"a":{"k":[{}],}}', '{"a":{"k":[{}]}} {}'])
def test_an_index_of_another_shape_fails(spark, tmp_path, text):
    (tmp_path / "i.json").write_text(text)
    with pytest.raises(Exception, match="must be a JSON object"):
        lk.read_index(spark, str(tmp_path / "i.json")).collect()


def test_empty_indexes(spark, tmp_path):
    for text in ("{}", ' {}\n', '{"a":{}}', '{"a":{"k":[]}, "b":{}}'):
        (tmp_path / "i.json").write_text(text)
        assert lk.read_index(spark, str(tmp_path / "i.json")).count() == 0


def test_requests_that_share_their_keys_are_looked_up_once(spark):
    keys = F.array(*[F.struct(F.lit(f"level{i}").alias("level"), F.lit(k).alias("key")) for i, k in ((1, ""), (2, "a"))])
    req = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 7, F.array(F.struct(
        F.lit("level1").alias("level"), F.lit("z").alias("key")))).otherwise(keys).alias("keys"))
    index = spark.createDataFrame([("level1", "", 0, "p"), ("level1", "", 1, "p"), ("level2", "a", 0, "q"),
                                   ("level2", "a", 1, "r"), ("level2", "a", 2, "s")],
                                  "level string, key string, pos int, val string")
    hits = lk.ladder_join(req, "keys", index, "val", "val", 3)
    assert {tuple(r) for r in hits.filter("row_id IN (3, 7)").collect()} == {(3, 0, "p"), (3, 1, "q"), (3, 2, "r")}
    assert hits.count() == 3 * 1999
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # requests meet finished hints only


def test_generated_records_can_be_valid(spark, tmp_path):
    from cribra.plans.batch import run_crystal_batch, run_scaffold_batch
    text = CIF

    def factory():
        return lambda prompts, n: [[text] * n for _ in prompts]

    inp = tmp_path / "in.csv"
    with open(inp, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(["material_id", "pretty_formula", "space_group", "scaffold_full"])
        w.writerow(["mp-1", "NaCl", "225", scaffold_text()])
    labelers = {"metric_family": lambda r: F.lit("M1"), "stack_family": lambda r: F.lit("NO_LAYER"),
                "position_family": lambda r: F.when(F.size(r["sites"]) == 8, "GENERAL_DOMINANT")}
    run = lambda name, **kw: run_crystal_batch(
        spark, str(inp), str(tmp_path / name), str(tmp_path / "cif"), factory=factory, strict=True, **kw)
    assert run("a", labelers=labelers)["accepted"] == 1
    assert run("b")["accepted"] == 0
    empty = tmp_path / "empty.csv"
    empty.write_text("material_id,pretty_formula,space_group\n")
    with pytest.raises(ValueError, match="No rows"):
        run_scaffold_batch(spark, str(empty), str(tmp_path / "c"), factory=factory)


def test_zero_lattice_and_compile_failure(spark):
    c = crystal_candidates(spark, scaffold_text(), [CIF.replace("_cell_length_a 5.64", "_cell_length_a 0")])[0]
    assert "zero_lattice" in c["verify_errors"]
    core = "\n".join(f"{k}={v}" for k, v in FULL.items() if k in rl.REQUIRED_CORE)
    core = core.replace(f"output_Z_raw={FULL['output_Z_raw']}", "output_Z_raw=9223372036854775807")
    cands = spark.createDataFrame([(0, f"{jobs.SCAFFOLD_BEGIN}\n{core}\n{jobs.SCAFFOLD_END}", "NaCl", 225)],
                                  "row_id long, response string, pretty_formula string, space_group int")
    got = jobs.compile_scaffolds(cands).first()["scaffold_errors"]
    assert got == ["compile_full_failed:bad_formula_or_Z"]


# ---------------------------------------------------------------- large groups, storage, resuming, committed files

def test_numbering_of_a_group_of_any_size(spark):
    rows = [(i, None if i % 3 == 0 else "hot", i * 7 % 1009) for i in range(1000)] + [(2000, "lone", 0)]
    df = spark.createDataFrame(rows, "id long, g string, o long").repartition(7)
    got = {r.id: r["rank"] for r in sl.number_large(df, ["g"], ["o", "id"], start=0).collect()}
    for g in (None, "hot", "lone"):
        own = sorted((o, i) for i, x, o in rows if x == g)
        assert [got[i] for _, i in own] == list(range(len(own)))
    assert sl.number_large(df.limit(0), ["g"], ["o"]).count() == 0


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    from cribra.sources.io import write_bucketed
    req = spark.createDataFrame([(i, f"m{i}", "NaCl", 225, scaffold_text()) for i in range(40)],
                                "row_id long, material_id string, pretty_formula string, space_group int, scaffold_full string")
    resp = spark.createDataFrame([(i, s, CIF if (i + s) % 3 else "data_x", "M1", "GENERAL_DOMINANT", "NO_LAYER")
                                  for i in range(40) for s in range(3)],
                                 "row_id long, seq int, response string, metric_family string, "
                                 "position_family string, stack_family string")
    want = sorted(map(str, jobs.crystal_job(req, resp, 2).collect()))
    stored = [write_bucketed(df, str(tmp_path / name), buckets=4) for df, name in ((req, "req"), (resp, "resp"))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to send
    try:
        job = jobs.crystal_job(*stored, 2, bucketed=True)
        assert "Exchange" not in job._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, job.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Exception, match="(?i)exists|non-empty"):
        write_bucketed(req, str(tmp_path / "req"), buckets=4)


def test_generation_goes_on_where_it_broke_off(spark, tmp_path):
    from cribra.operators.generate import generate_resumable
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory(broken):
        def make():
            def gen(prompts, n):
                for p in prompts:
                    (calls / f"{p}-{len(list(calls.glob(p + '-*')))}").touch()
                if broken and any(p in ("p7", "p31") for p in prompts):
                    import os
                    os._exit(1)  # the worker dies: no error row, the wave fails
                return [[f"{p}:{i}" for i in range(n)] for p in prompts]
            return gen
        return make

    req = spark.range(40).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), "id").alias("prompt"))
    path = str(tmp_path / "responses")
    with pytest.raises(Exception):
        generate_resumable(req, factory(True), 2, path, waves=8).collect()
    done = {r.row_id for r in spark.read.parquet(path).collect()}
    assert 0 < len(done) < 40
    before = {f.name.split("-")[0] for f in calls.iterdir()}
    for f in list(calls.iterdir()):
        f.rename(tmp_path / f"old-{f.name}")
    out = generate_resumable(req, factory(False), 2, path, waves=8)
    assert out.count() == 80 and out.select("row_id", "seq").distinct().count() == 80
    asked = {f.name.split("-")[0] for f in calls.iterdir()}
    assert asked == {f"p{i}" for i in range(40) if i not in done} and before
    n = len(list(calls.iterdir()))
    generate_resumable(req, factory(True), 2, path, waves=3).collect()  # finished: nobody is asked
    assert len(list(calls.iterdir())) == n


def test_failed_prompts_are_tried_again_on_request(spark, tmp_path):
    from cribra.operators.generate import generate_resumable
    req = spark.createDataFrame([(0, "a"), (1, "boom")], "row_id long, prompt string")
    path = str(tmp_path / "r")
    out = generate_resumable(req, _factory("A"), 1, path, waves=2)
    assert sorted((r.row_id, r.error is None) for r in out.collect()) == [(0, True), (1, False)]
    fixed = req.withColumn("prompt", F.lit("fine"))
    assert generate_resumable(fixed, _factory("B"), 1, path).filter("error IS NOT NULL").count() == 1
    out = generate_resumable(fixed, _factory("B"), 1, path, retry_errors=True)
    assert sorted((r.row_id, r.response) for r in out.collect()) == [(0, "A:a0"), (1, "B:fine0")]


def test_small_splits_of_an_object_share_tasks(spark, tmp_path):
    import json
    from pathlib import Path
    from cribra.operators.lookup import read_index
    from cribra.session import shared_path
    lists = {"level1": {f"k{i}": [{"v": f"{i}}}{j}"} for j in range(3)] for i in range(300)}}
    path = tmp_path / "index.json"
    path.write_text(json.dumps(lists), encoding="utf-8")
    folder = Path(shared_path(spark, "x").removeprefix("file:")).parent
    known = set(folder.glob("pieces-*"))
    rows = read_index(spark, str(path), split_bytes=64).collect()
    assert sorted((r.level, r.key, r.pos, r.row.toPython()["v"]) for r in rows) == sorted(
        ("level1", k, j, x["v"]) for k, many in lists["level1"].items() for j, x in enumerate(many))
    made, = set(folder.glob("pieces-*")) - known
    assert len(list(made.glob("*.parquet"))) <= 4 * spark.sparkContext.defaultParallelism


def test_text_files_in_the_shared_folder_of_a_cluster(spark, tmp_path, monkeypatch):
    from cribra.session import checkpoint_dir, shared_path
    from cribra.sources.io import read_text, text_files, write_text_files
    checkpoint_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "row_id long, name string, text string")
    for path in (shared_path(spark, "texts"), "file:" + shared_path(spark, "texts").removeprefix("file:")):
        write_text_files(text_files(df, "name", "text", path, suffix=".txt"), path)
        assert sorted(r.text for r in read_text(spark, path).collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="not a shared path"):
        write_text_files(text_files(df, "name", "text", str(tmp_path / "own")), str(tmp_path / "own"))
    with pytest.raises(ValueError, match="not a shared path"):
        out = shared_path(spark, "x") + "/../../../../../out"
        write_text_files(text_files(df, "name", "text", out), out)


def test_text_files_stand_only_after_the_commit(spark, tmp_path):
    from cribra.sources.io import TextFileWriter, text_files, write_text_files
    folder = tmp_path / "out"
    files = spark.range(20).select(F.col("id").alias("row_id"), F.concat(F.lit("n/"), F.col("id") % 15).alias("name"),
                                   F.concat(F.lit(" t"), "id").alias("text")).repartition(4)
    table = text_files(files, "name", "text", str(folder), suffix=".txt")
    write_text_files(table, str(folder))
    got = {p.name: p.read_text() for p in folder.iterdir()}
    assert got == {f"n_{i}.txt": f"t{i + 15 if i < 5 else i}\n" for i in range(15)}
    bad = table.withColumn("text", F.when(F.col("row_id") == 17, F.raise_error(F.lit("killed"))).otherwise("new"))
    with pytest.raises(Exception, match="killed"):
        write_text_files(bad, str(folder))
    assert {p.name: p.read_text() for p in folder.iterdir()} == got
    w = TextFileWriter(str(folder))
    from pyspark.sql import Row
    message = w.write(iter([Row(path=str(folder / "x.txt"), text="x")]))
    assert not (folder / "x.txt").exists()
    w.abort([message])
    assert {p.name for p in folder.iterdir()} == set(got)
    assert "hashpartitioning(path" not in table._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- work once per request, per text

def test_formulas_and_fields_as_the_column_functions_read_them(spark):
    from cribra.functions import formula as fm
    from cribra.operators import parse as ps
    texts = {"H2O": {"H": 2, "O": 1}, " Na Cl ": {"Na": 1, "Cl": 1}, "Ca(OH)2": {"Ca": 1, "O": 2, "H": 2},
             "Li0.5CoO2": {"Li": 5, "Co": 10, "O": 20}, "CuSO4*5H2O": {"Cu": 1, "S": 1, "O": 9, "H": 10},
             "H9223372036854775807": {"H": 2 ** 63 - 1}, "H9223372036854775807H": None, "H01": None, "": None,
             "H0." + "0" * 30 + "1C": None, "(H4)4611686018427387904": None, "(2H)": None, "<H>": None, "*H": None}
    got = col_values(spark, [*texts, None], fm.formula_counts)
    assert [g and {p["element"]: p["n"] for p in g} for g in got] == [*texts.values(), None]
    got = col_values(spark, ["b=1\r\na = x=y \rb=2\n=3\nno", "", None], ps.kv_map)
    assert got == [{"a": "x=y", "b": "2"}, {}, {}]


def test_response_text_is_made_once(spark):
    """No filter in front of the exchange repeats the expression that makes the text."""
    from cribra.plans import jobs
    resp = spark.range(4).selectExpr("id % 2 AS row_id", "id AS seq", "concat('text ', id) AS response")
    out = jobs.prepare_responses(resp, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(text ") == 1, plan
    blank = spark.createDataFrame([(1, 0, " \t"), (1, 1, None), (1, 2, "a"), (1, 3, ""), (1, 4, " a "), (1, 5, "b")],
                                  "row_id long, seq long, response string")
    got = [(r["seq"], r["rank"], r["response"]) for r in jobs.prepare_responses(blank, 2).orderBy("seq").collect()]
    assert got == [(2, 0, "a"), (5, 1, "b")]


# ---------------------------------------------------------------- batches of crystal texts

def test_batch_steps_read_as_the_columns_do(spark):
    """T3 and T1 over Arrow batches give what the Column functions give."""
    values = ["1", "90.0", "2.0000005", "3.25(2)", "'4'", "-0.0000004", "123456789.1234565", "1e999", "bad", "0"]
    forms = ["NaCl", "'Na Cl'", "\n;two\nlines\n;", "loop_x", "unknown", "(a)", "\"it's\"", "xé"]
    texts = []
    for i in range(240):
        v = [values[(i * 7 + k * (i % 3)) % len(values)] if i % 4 == 3 else values[(i + k) % 3] for k in range(6)]
        cell = "".join(f"_cell_{name} {x}\n" for name, x in zip(
            ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma"), v))
        sites = "".join(f"s{j} {('Na', 'Cl', chr(39) + 'O 1' + chr(39))[(i + j) % 3]} 0.{j} -0.0000001 {values[(i + j) % 3]}\n"
                        for j in range(i % 5))
        texts.append(f"data_{'x' * (i % 2)}\n_chemical_formula_structural {forms[i % len(forms)]}\n{cell}"
                     f"_cell_formula_units_Z {('1', '2', '004', '0')[i % 7 % 4]}\n{SITES}{sites}" + "1 2\n" * (i % 11 == 0))
    texts += ["", " \n　", "data_", "#", "loop_ data_a data_b _cell_length_a", "_atom_site_label", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(3)
    pick = ("i", "r.parse_error", "r.sites", "cif", "canonicalized", "canonicalize_error", "counts")
    one, two = [sorted(map(repr, ps.with_canonical(ps.with_crystal_record(df, "t", "r", canonical=c), "r", "t")
                           .select(*pick).collect())) for c in (True, False)]
    assert one == two
    assert sum("canonicalized=True" in x for x in one) > 40
    texts = ["b=1\r\na = x=y \rb=2\n=3\nno", "", None, "　k\x85=\tv ", "a=\nA=1\na=2"]
    assert col_values(spark, texts, ps.kv_map_batches) == col_values(spark, texts, ps.kv_map)


def test_batch_steps_take_any_number_of_texts():
    import pyarrow as pa
    from cribra.operators.crystal import canonical_records, records
    whole = ["data_a\n" + CELL + "_cell_formula_units_Z 4\n" + SITES + "a Na 0 0 0\n", None, "", "'", "x", "data_ '"]
    want = [r for t in whole for r in canonical_records(pa.array([t], pa.string())).to_pylist()]
    assert canonical_records(pa.array(whole)).to_pylist() == want and want[0]["counts"] == [{"element": "Na", "n": 1}]
    assert canonical_records(pa.array(["cut", *whole])[1:]).to_pylist() == want
    assert len(records(pa.array([], pa.string()))) == 0 and records(pa.array(whole)).to_pylist()[0]["z"] == 4


def test_numbers_at_six_decimals_round_as_the_formatter_does(spark):
    import numpy as np
    from cribra.operators.crystal import _six
    values = [5e-7, -5e-7, 1.5e-6, 1.0000005, -0.0, 2.5e-7, 1e8, 123456789.1234565, 33333333.3333335, 1e22, 2.675]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").orderBy("i")
    want = [r.s for r in df.select(F.format_string("%.6f", "v").alias("s")).collect()]
    assert _six(np.array(values)).to_pylist() == want
    rec = F.struct(F.lit("x").alias("name"), F.lit("x").alias("formula_structural"), F.lit("x").alias("formula_sum"),
                   *[F.col("v").alias(k) for k in ("cell_a", "cell_b", "cell_c", "alpha", "beta", "gamma")],
                   F.lit(1).alias("z"), F.array(F.struct(F.lit("Na").alias("element"), *[F.col("v").alias(k) for k in "xyz"]))
                   .alias("sites"), F.lit(None).cast("string").alias("parse_error"))
    got = df.select(jobs.canonical_record(rec).alias("r")).collect()
    assert [repr(r.r.cell_a) for r in got] == [repr(float(x)) for x in want]


def test_responses_that_lie_by_request_move_no_more(spark):
    """Texts made from rows that a window dealt out by request are not exchanged again."""
    from pyspark.sql import Window
    w = Window.partitionBy("row_id").orderBy("id")
    resp = spark.range(40).selectExpr("id % 4 AS row_id", "id").withColumn("seq", F.row_number().over(w)) \
        .selectExpr("row_id", "seq", "concat('text  ', seq % 3) AS response")
    out = jobs.prepare_responses(resp, None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION" not in plan, plan
    assert sorted((r.row_id, r["rank"], r.seq) for r in out.collect()) == [(i, j, j + 1) for i in range(4) for j in range(3)]


def test_best_and_all_files_are_compressed(spark, tmp_path):
    from cribra.sources.io import write_json
    text = "data_x\n" + CELL * 20
    df = spark.createDataFrame([(i, text) for i in range(200)], "row_id long, cif string").coalesce(1)
    write_json(df, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    assert files and sum(f.stat().st_size for f in files) < 200 * len(text) / 10
    assert spark.read.json(str(tmp_path / "out"), schema=df.schema).distinct().count() == 200
