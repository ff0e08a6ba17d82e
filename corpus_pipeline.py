"""A training-corpus pipeline of five stages: run(spark, sf_dir) applies them to documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of documents, whatever other columns there are. Rows
with a null doc_id or the same doc_id are rows like others; an empty table gives an empty result; each operator's
docstring says what it does with null, empty and very long texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import common, decontaminate, jaccard_join, language_id, mixing, queries, token_output


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts, texts without letters, and texts in no language that was learned go."""
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 0.8 or more; texts without words all stay."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item to a 20th of their words; an empty benchmark keeps all."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that the expected words of good, poor and toxic text match the targets."""
    return mixing.apply_rates(docs, mixing.quality_domains(common.read(spark, sf_dir, "labels")))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder, described as they read back."""
    return token_output.token_report(docs, queries.tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_to_targets),
    ("token_output", write_tokens),
]

#: Classifiers, rates and tokens can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.new_path(spark, f"stage-{name}")
        (out := stage(spark, docs, sf_dir)).write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
