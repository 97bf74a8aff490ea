"""Exact length histogram of encoded documents.

Documents are aggregated by encoded length; running sums over the histogram then
answer totals, quantiles and truncated totals for every context limit.  The
histogram has one row per distinct length, whatever the number of documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cribra.llm.bpe import _rank_bytes, codec
from cribra.llm.common import persist_shared

#: Lengths per block of the two-level running sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``n_tokens long`` of every row; null and empty texts have length 0."""
    ranks = _rank_bytes(docs, path)

    def run(batches):
        c = codec(ranks.value, pattern)
        for batch in batches:
            n = [len(c.encode(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``length, n_docs``: partial counts per task, then one row per length."""
    return (lengths.groupBy(F.col(length_col).cast("long").alias("length"))
            .agg(F.count(F.lit(1)).alias("n_docs")))


def limits(hist: DataFrame) -> DataFrame:
    """One row per distinct length L, taken as a context limit.

    ``length, n_docs``: the histogram.  ``docs_within``: documents of length <= L;
    ``docs_over``: longer ones; ``quantile``: docs_within over all documents, so the
    q-quantile is the smallest length whose quantile is >= q.  ``tokens_within``:
    tokens of documents of length <= L; ``truncated_tokens``: tokens left when every
    document is cut at L; ``total_docs``, ``total_tokens``: over everything.  Totals
    at a limit between two lengths L1 < x < L2 follow from the row of L1:
    tokens_within + x * docs_over.  An empty input gives no rows; ties are one row.

    Running sums go in two levels (blocks of lengths, lengths inside a block), so
    no single task holds the histogram.
    """
    # read twice below: texts must not be encoded twice
    h = persist_shared(hist, "lengths").withColumn("block", F.floor(F.col("length") / F.lit(BLOCK))) \
            .withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # one row per block of lengths: as many as the longest document has blocks
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("bd").over(whole).alias("total_docs"),
        F.sum("bt").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy("length") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = h.join(blocks, "block") \
        .withColumn("docs_within", F.col("docs_before") + F.sum("n_docs").over(inside)) \
        .withColumn("tokens_within", F.col("tokens_before") + F.sum("tokens").over(inside)) \
        .withColumn("docs_over", F.col("total_docs") - F.col("docs_within"))
    return j.select(
        "length", "n_docs", "docs_within", "docs_over",
        (F.col("docs_within") / F.col("total_docs")).alias("quantile"),
        "tokens_within",
        (F.col("tokens_within") + F.col("length") * F.col("docs_over")).alias("truncated_tokens"),
        "total_docs", "total_tokens")
