"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; it is written as
Parquet to the shared folder and read again before the next stage begins, so that no stage runs twice.  All but the last
return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regmodel.llm import common, decontaminate, near_dups, pieces, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dups.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.redact(docs, secrets.train(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text_crc32, exact, token_ids."""
    return pieces.encode(docs, pieces.default_model())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: The ratios, sketches and trained weights of the stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
