"""Generation hook (survey U1).

The only step that runs Python per batch: a caller-supplied generator turns
prompts into ``n`` texts each.  ``mapInPandas`` hands it whole Arrow batches;
the generator is built once per Python worker by the caller's ``factory`` and
cached under a name of this call, so two generators never meet.  When a batch
fails or comes back with the wrong number of lists it is tried again prompt by
prompt, and only the prompts that fail themselves get an ``error``.  Write the
output to a table (``persist_responses``) before verification so the expensive
step never runs twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.session import write_shared

RESPONSE_SCHEMA = "row_id long, seq int, response string, error string"


_WORKER: dict[str, Callable] = {}


def worker_generator(key: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's generator for one ``generate`` call; an older call's goes."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = factory()
    return _WORKER[key]


def _texts(gen: Callable, prompts: list[str], n: int) -> list[list[str]]:
    outs = [list(x) for x in gen(prompts, n)]
    if len(outs) != len(prompts):
        raise ValueError(f"generator returned {len(outs)} lists for {len(prompts)} prompts")
    return outs


def _each(gen: Callable, prompts: list[str], n: int) -> list[list[str] | Exception]:
    """Texts per prompt, or the exception of a prompt that fails on its own."""
    try:
        return _texts(gen, prompts, n)
    except Exception as exc:  # noqa: BLE001 - reported per row, job goes on
        if len(prompts) == 1:
            return [exc]
        return [x for p in prompts for x in _each(gen, [p], n)]


def generate(df: DataFrame, factory: Callable[[], Callable[[Sequence[str], int], list]],
             n: int, key: str = "row_id", prompt: str = "prompt",
             partition: bool = True, prompt_error: Column | None = None) -> DataFrame:
    """``(key, prompt)`` -> ``(row_id, seq, response, error)``.

    ``factory()`` returns ``gen(prompts, n) -> list[list[str]]`` (n texts per
    prompt, in order); texts are stripped.  With ``partition`` the requests are
    hash-partitioned by ``key`` first, so all responses of a request come out
    of one task.  A request with a non-null ``prompt_error`` (F20: see
    ``text.token_budget_error``) never reaches the generator and keeps that error.
    """
    if n < 1:
        raise ValueError("num_return_sequences must be positive")
    src = df.select(F.col(key).cast("long").alias("row_id"), F.col(prompt).alias("prompt"),
                    (F.lit(None) if prompt_error is None else prompt_error).cast("string").alias("error"))
    if partition:
        src = src.repartition("row_id")
    call = uuid.uuid4().hex

    def run(batches):
        for pdf in batches:
            known = pdf["error"].notna()
            rows = [(rid, 0, None, e) for rid, e in zip(pdf["row_id"][known], pdf["error"][known])]
            todo = pdf[~known]
            if len(todo):
                gen = worker_generator(call, factory)
                outs = _each(gen, todo["prompt"].fillna("").tolist(), n)
                for rid, texts in zip(todo["row_id"], outs):
                    if isinstance(texts, Exception):
                        rows.append((rid, 0, None, f"{type(texts).__name__}: {texts}"))
                    else:
                        rows += [(rid, s, str(t).strip(), None) for s, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["row_id", "seq", "response", "error"])

    return src.mapInPandas(run, RESPONSE_SCHEMA)


def persist_responses(spark: SparkSession, responses: DataFrame, path: str) -> DataFrame:
    """Write generated responses to parquet and read them back: lineage is cut
    at the expensive step, and a lost executor later never re-runs the model.
    Fails if ``path`` exists, so that two jobs never share a table."""
    responses.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def generate_resumable(requests: DataFrame, factory: Callable, n: int, path: str, waves: int = 16,
                       key: str = "row_id", prompt: str = "prompt", prompt_error: Column | None = None,
                       retry_errors: bool = False) -> DataFrame:
    """U1 in ``waves``, each appended to the table at ``path`` when it is done.

    A run that breaks off has lost its last wave at most: started again with the same
    path, an anti join leaves only the requests without committed responses (with
    ``retry_errors`` also those that failed).  Each wave takes a hash share of the
    requests and all tasks, and its append is committed as a whole.  A finished table
    answers without calling the generator; requests are told apart by ``key``.
    """
    if waves < 1:
        raise ValueError("waves must be positive")
    spark = requests.sparkSession
    src = requests.select(F.col(key).cast("long").alias("row_id"), F.col(prompt).alias("prompt"),
                          (F.lit(None) if prompt_error is None else prompt_error).cast("string").alias("_known"))
    share = F.pmod(F.xxhash64("row_id"), F.lit(waves))

    def committed() -> DataFrame:
        """What ``path`` holds; an empty append makes the table."""
        empty = spark.createDataFrame([], RESPONSE_SCHEMA)
        try:
            return spark.read.schema(RESPONSE_SCHEMA).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            empty.write.mode("append").parquet(path)
            return spark.read.schema(RESPONSE_SCHEMA).parquet(path)

    done = committed()
    done = done.filter("error IS NULL") if retry_errors else done
    left = write_shared(src.join(done.select("row_id").distinct(), "row_id", "left_anti"), "left")
    for wave in range(waves):
        todo = left.filter(share == wave)
        if not todo.isEmpty():
            generate(todo, factory, n, prompt_error=F.col("_known")).write.mode("append").parquet(path)
    out = committed()
    if retry_errors:  # a failure that a later run made good goes
        fine = out.filter("error IS NULL").select("row_id").distinct()
        failed = out.filter("error IS NOT NULL").join(fine, "row_id", "left_anti") \
            .groupBy("row_id", "seq").agg(F.max("response").alias("response"), F.max("error").alias("error"))
        return out.filter("error IS NULL").unionByName(failed)
    return out
