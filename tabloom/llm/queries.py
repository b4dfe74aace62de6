"""Registered queries: each applies one operator to the whole of its table. Digest columns are made here, from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, language, licences, minhash, mixing, oracles, periods, pii, quality, secrets, suffixes, url_filter, vectors

VOCABULARY_NAME = "word_bpe_49k.json"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, table: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = (lambda spark, sf_dir: fn(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in table.split())), sql)
        return fn

    return add


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY_NAME)


def sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


@register("op1_url_filter", "pages", oracles.OP1)
def op1(pages: DataFrame) -> DataFrame:
    return url_filter.judge_urls(pages, url_filter.rule_table(pages.sparkSession, URL_RULES))


@register("op2_quality", "documents", oracles.OP2)
def op2(docs: DataFrame) -> DataFrame:
    judged = quality.judge_documents(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


@register("op4_bpe", "documents")
def op4(docs: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(docs, vocabulary_path())
    return coded.select("doc_id", F.col("n_tokens").cast("long"), sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


@register("op5_mixing", "documents")
def op5(docs: DataFrame) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


@register("op9_minhash", "documents", oracles.OP9)
def op9(docs: DataFrame) -> DataFrame:
    return minhash.near_duplicates(docs).select("doc_id", F.col("n_shingles").cast("long"), "component_id", "kept")


@register("op6_pivot_index", "embeddings", oracles.OP6)
def op6(embeddings: DataFrame) -> DataFrame:
    return vectors.near_vectors(embeddings)


@register("op8_suffix_dedup", "documents")
def op8(docs: DataFrame) -> DataFrame:
    cut = suffixes.remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    # a character of which a removed run takes some bytes is U+FFFD in the text; the digest is over the bytes
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), sha256("kept").alias("kept_sha256"),
                      F.octet_length("kept").cast("long").alias("n_kept"), left.alias("text"))


@register("op3_pii", "documents")
def op3(docs: DataFrame) -> DataFrame:
    found = pii.find_personal_data(docs)
    counts = [pii.number_of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("plain")).cast("binary"), 256).alias("base_sha256"), pii.written(pii.all_spans()).alias("spans"))


@register("op7_language", "pages documents")
def op7(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return language.identify(pages, docs)


@register("op10_licences", "documents")
def op10(docs: DataFrame) -> DataFrame:
    found = licences.document_licences(docs)
    return found.select("doc_id", F.array_join("families", ",").alias("families"), F.col("n_paragraphs").cast("long"), F.round("probability", 6).alias("probability"))


@register("op11_centroids", "embeddings", oracles.op11())
def op11(embeddings: DataFrame) -> DataFrame:
    written = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    found = centroids.cluster(embeddings)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written.cast("binary"), 256).alias("centroid_sha256"))


@register("op12_secrets", "documents")
def op12(docs: DataFrame) -> DataFrame:
    base, every = secrets.spans(secrets.BASE), secrets.spans()
    counts = [secrets.number_of(k, secrets.BASE).alias(f"n_{k}") for k in secrets.KINDS]
    return secrets.scan(docs).select("doc_id", *counts, F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"), pii.written(every).alias("spans"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, chosen by the id's CRC, repeats a stretch of its own words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n.cast("long"))
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " "))

    # the words are bound once, as the only element of an array
    words = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    changed = F.coalesce(F.element_at(F.transform(words, planted), 1), F.col("text"))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(F.col("text")).alias("text"))


@register("op13_periods", "documents")
def op13(docs: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(F.lit(""))
    return periods.find_runs(with_planted_period(docs)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.floor(1000 * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), sha256("collapsed").alias("collapsed_sha256"))
