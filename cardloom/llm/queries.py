"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    resampling,
    sharding,
    suffix_dedup,
    token_output,
    toxicity,
    url_filter,
    vector_dedup,
    whitening,
)
from .common import read

#: Where the public tokenizers' files are; None asks the package that brings them.
TOKENIZERS: str | None = None
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(folder: str | None = TOKENIZERS) -> str:
    if folder:
        return f"{folder}/{TOKENIZER}"
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_report(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(read(spark, sf_dir, "documents"), mixing.quality_domains(read(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_token_output": op4_token_output,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_sharding": op11_sharding,
    "op12_resampling": op12_resampling,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": url_filter.sql(),
    "op11_sharding": sharding.sql(),
    "op12_resampling": resampling.sql(),
}
