"""Stages of the corpus pipeline: each applies one operator to all documents it gets. All but the last keep the columns of
``documents``; where a text changes, ``n_chars`` follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, minhash, mixing, pii
from . import quality as rules
from .queries import sha256, vocabulary_path


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their source share."""
    return counted(rules.clean_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return counted(pii.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def bpe_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (base64 of unsigned 32-bit integers, little end first) and digests of ids and decoded text."""
    coded = bpe.encode_decode(docs, vocabulary_path())
    return coded.select("doc_id", F.col("n_tokens").cast("long"), F.base64("ids").alias("ids"), sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))
