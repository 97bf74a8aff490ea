"""End-to-end batch programs (the reference's two batch mains as Spark jobs).

CSV requests -> checks -> job -> result CSV in input order (+ one text file per
accepted row for the crystal job).  Row counts (A6) are collected with
``DataFrame.observe`` during the write, not by a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cribra.functions.text import token_budget_error
from cribra.operators.generate import generate, generate_resumable, persist_responses
from cribra.plans import jobs
from cribra.session import shared_path, write_shared
from cribra.sources.io import (read_requests, read_text, text_files, write_results,
                               write_text_files)


def load_hint_text(spark: SparkSession, path: str) -> str:
    """S3 + J4: a small hint file (one text, stripped) used as a constant for
    every request.  Only the text of that one file reaches the driver."""
    rows = read_text(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(f"Prototype hint file not found or not one file: {path}")
    return rows[0]["text"]


def _responses(spark: SparkSession, requests: DataFrame, responses: DataFrame | None,
               factory, n: int, prompt_col: str, prompt_error: Column | None = None,
               resume: str | None = None) -> DataFrame:
    """A ready responses table, or U1 over the requests with the output cut to
    a table in the shared folder (the model never runs twice); ``resume`` names a table
    that a run which broke off goes on with."""
    if responses is not None:
        return responses
    if factory is None:
        raise ValueError("give a responses table or a generator factory")
    if resume is not None:
        return generate_resumable(requests, factory, n, resume, prompt=prompt_col, prompt_error=prompt_error)
    gen = generate(requests, factory, n, prompt=prompt_col, prompt_error=prompt_error)
    return persist_responses(spark, gen, shared_path(spark, "responses"))


def _budget_error(prompt_tokens: Column | None, max_len: int | None) -> Column | None:
    """F20 before the call, when the caller can count a prompt's tokens."""
    if prompt_tokens is None or max_len is None:
        return None
    return token_budget_error(prompt_tokens, F.lit(max_len))


def _with_hints(requests: DataFrame, hint_text: str | None, index: DataFrame | None) -> DataFrame:
    """J4 precedence (hint text over index), J1 ladder over the scaffold fields."""
    from cribra.operators.lookup import attach_hints, hint_block, ladder_join, ladder_keys, row_text
    from cribra.operators.parse import kv_map
    if hint_text or index is None:
        return attach_hints(requests, hint_text=hint_text)
    keyed = requests.select("row_id", ladder_keys(kv_map("scaffold_full")).alias("keys"))
    hits = ladder_join(keyed, "keys", index.withColumn("hint", row_text(F.col("row"))),
                       F.to_json(F.col("row")), "hint")
    return attach_hints(requests, blocks=hint_block(hits, "hint"))


def run_scaffold_batch(spark: SparkSession, input_csv: str, output_csv: str, *,
                       responses: DataFrame | None = None, factory=None, num_samples: int = 6,
                       first_n: int | None = None, instruction: str = "",
                       single_file: bool = False, prompt_tokens: Column | None = None,
                       max_len: int | None = None, resume: str | None = None) -> dict:
    """Q1 end to end; returns ``{"written": n}``.

    ``resume`` is a path that keeps finished responses: after a failure the same call
    generates only what is missing there.

    ``prompt_tokens`` counts the tokens of column ``prompt``; with ``max_len`` a
    prompt that leaves no room is not sent and reported as ``prompt_too_long``.
    """
    req = read_requests(spark, input_csv, jobs.SCAFFOLD_INPUT, first_n)
    good, _ = jobs.split_requests(req, require=input_csv)  # first bad row fails the job
    resp = _responses(spark, jobs.scaffold_prompts(good, instruction), responses, factory,
                      num_samples, "prompt", _budget_error(prompt_tokens, max_len), resume)
    out = jobs.scaffold_job(good, resp, num_samples)
    obs = Observation("scaffold")
    # the sink orders the rows, which reads them twice: count and compute them once
    out = write_shared(out.observe(obs, F.count(F.lit(1)).alias("written")), "scaffold")
    write_results(out, output_csv, jobs.SCAFFOLD_OUTPUT, single_file=single_file)
    return {"written": obs.get["written"]}


def run_crystal_batch(spark: SparkSession, input_csv: str, output_csv: str, output_dir: str, *,
                      responses: DataFrame | None = None, factory=None, num_samples: int = 1,
                      strict: bool = False, first_n: int | None = None,
                      instruction: str = "", hint_text: str | None = None,
                      index: DataFrame | None = None, write_files: bool = True,
                      single_file: bool = False, prompt_tokens: Column | None = None,
                      max_len: int | None = None, labelers: dict | None = None,
                      resume: str | None = None) -> dict:
    """Q2 end to end: result CSV plus one ``<stem>.cif`` per accepted row
    (P15: a strict reject writes no file).  Returns row counts and the number of
    stem collisions (the reference silently overwrote such files).

    ``labelers`` maps a label (see ``jobs.LABELS``) to a function of the parsed
    record's Column, for responses that bring no label columns; ``prompt_tokens``
    and ``max_len`` and ``resume`` as in ``run_scaffold_batch``.
    """
    req = read_requests(spark, input_csv, jobs.CIF_INPUT, first_n)
    good, _ = jobs.split_requests(req, with_scaffold=True, require=input_csv)
    todo = good.filter(F.col("scaffold_full") != "")     # P18: skip before generation
    if responses is None:
        todo = _with_hints(todo, hint_text, index)
        todo = jobs.crystal_prompts(todo, instruction, "hints")
    resp = _responses(spark, todo, responses, factory, num_samples, "prompt",
                      _budget_error(prompt_tokens, max_len) if responses is None else None, resume)
    out = jobs.crystal_job(good, resp, num_samples, strict=strict, out_dir=output_dir,
                           labelers=labelers)
    obs = Observation("crystal")
    out = out.observe(obs, F.count(F.lit(1)).alias("written"),
                      F.count_if(F.col("outcome") == "success").alias("accepted"))
    # the result feeds two sinks: write it once to the shared checkpoint folder
    # so the job is not computed twice
    out = write_shared(out, "crystal")
    counts = dict(obs.get)
    write_results(out, output_csv, jobs.CIF_OUTPUT, single_file=single_file)
    if write_files:
        files = text_files(out.filter(F.col("outcome") == "success"), "material_id", "cif",
                           output_dir)
        write_text_files(files, output_dir)
        counts["stem_collisions"] = files.filter(~F.col("kept")).count()
    return counts
