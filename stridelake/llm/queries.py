"""The named queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from stridelake.llm import (
    alignment,
    bpe,
    conversations,
    exact_dedup,
    imatch,
    language,
    line_dedup,
    minhash,
    mixing,
    passages,
    secret_scan,
    surrogates,
    toxicity,
)
from stridelake.llm.common import documents, labels
from stridelake.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table names one origin for each document: its source stands for repository and owner.
    return secret_scan.find_secrets(documents(spark, sf_dir), repo="source", owner="source")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(documents(spark, sf_dir))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.imatch(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    first, second = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")
    return alignment.align(documents(spark, sf_dir), first, files.PATTERN, second, digest=True)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_secret_scan": op4_secret_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_imatch": op7_imatch,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_bpe": op10_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
