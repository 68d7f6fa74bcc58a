"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
documents: quality rules, near-duplicate removal and decontamination drop rows, the secret scan
replaces secrets in the text (and n_chars with it). The last one returns token ids: the
best-scoring ones and, as merge_ids, what the model's merge order gives.

Cases: null and empty texts go in the first stage; rows with a null doc_id are never near duplicates or leaks and stay. Rows that
repeat an id with other texts are documents of their own; of equal rows one stays. Ties between near duplicates go to the least id,
then the least hash of the text. Very long texts pass whole. Other columns are kept until the last stage, whatever their names. An empty
table gives none. A stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm import decontaminate, minhash_dedup, rule_ledger, secrets, viterbi
from dyadic.llm.common import read, remove, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ledger.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return viterbi.encode_decode(docs, also_merges=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: The last stages have no SQL form (a Viterbi search, trained models); the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, *last)
        docs, last = spark.read.parquet(path), [path]
    return docs
