"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cribra.llm import (bpe, chat, cover_tree, fingerprints, hard_negatives, lang_id, lm_score, merkle, mixing,
                        near_dups, secrets, substrings, token_counts)
from cribra.llm.common import RANKS, WEIGHTS, table

def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents"), WEIGHTS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"),
                                           public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return token_counts.limits(token_counts.histogram(lengths))


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_tricky(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_windows(turns, budget=1024, history=128))


def op9_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.threshold_links(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_by_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_lang_id": op3_lang_id,
    "op4_fingerprints": op4_fingerprints,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_near_dups": op6_near_dups,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_embedding_near_dups": op9_embedding_near_dups,
    "op10_lm_score": op10_lm_score,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_mix_sources": mixing.MIX_SQL,
    "op6_near_dups": near_dups.NEAR_SQL,
    "op8_chat_format": chat.CHAT_SQL,
    "op9_embedding_near_dups": cover_tree.LINKS_SQL,
    "op11_hard_negatives": hard_negatives.MINE_SQL,
    "op12_substring_dedup": substrings.REPEATS_SQL,
    "op13_merkle_manifest": merkle.MERKLE_SQL,
}
