"""From documents to token ids: language, near-duplicates, secrets, mixture, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it
kept; its result is written as Parquet and read again as the next one's ``docs``.
Null texts and texts without a letter go in the first stage, so the later ones see
text only; an empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cribra.llm import bpe, lang_id, mixing, near_dups, secrets
from cribra.llm.common import RANKS, WEIGHTS, persist_shared, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` stays as it came."""
    return lang_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near-duplicates."""
    return near_dups.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask, at most 3 times."""
    return mixing.repeat_documents(docs, WEIGHTS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with a digest of what they decode to."""
    return bpe.tokenize(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
                        keep=("lang", "source"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", encoding),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = persist_shared(docs, f"stage-{i}")
    return docs
