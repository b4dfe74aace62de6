"""The corpus pipeline: quality rules, near-dedup, personal data, mixing and encoding, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import stages
from tabloom.session import scratch_path

STAGES = [
    ("quality", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("personal_data", stages.personal_data),
    ("mixing", stages.mixing_stage),
    ("bpe", stages.bpe_codes),
]

# Personal data patterns, sampling by hash and BPE have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
