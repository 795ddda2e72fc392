"""A training corpus from the documents table: four filters and a mixture.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept.  ``run`` writes each stage's rows as Parquet in the shared folder and reads
them again, so a lost executor never costs more than one stage.

Defined results: null and empty texts pass every stage; a null doc_id is scored and
searched by its text and is no near-duplicate of anything; repeated rows are kept or
dropped together, but for near-duplicates, which are dropped by doc_id; an empty table
gives an empty result; further columns stay, whatever their names, but copy and
shuffle_key, which the last stage writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import decontaminate, mixing, neardup, secret_scan, toxicity
from quizloom.llm.scratch import remove, store, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group stays."""
    return neardup.clean(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same share for each source, drawn by Poisson replication and globally shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
]

#: The models and the candidate search have no SQL; tests hold each stage against brute force or its operator's query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = stored()
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
        # What the stage wrote on its way, and the rows of the one before it, aren't read any more.
        *done, _ = [path for path in stored() if path not in before]
        remove(spark, done)
    return docs.select("doc_id", "copy", "source", "lang", "n_chars", F.sha2("text", 256).alias("text_sha256"), "shuffle_key")
