"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host the distinct texts that carry a line are counted; a line in more than
``max_docs`` texts of a host is removed from all documents of that host but the one with the least id, so that no line is lost
altogether. A document is rejected when the plain rules fail or when less than ``min_left`` of its words are left.

Defined cases: a null text has no words and fails; null is a host of its own; a document without an id never is the one that
keeps a line; equal texts count once towards a line, so copies alone remove nothing; lines that hold no letter or digit are
not counted; an empty table gives an empty result; other columns are not read. Lines are told apart by 64 bits of hash.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import split_join
from .rows import cut_lineage, map_rows, sql_type, text_key

MAX_DOCS = 20
MIN_LEFT = 1 / 3
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows of three
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_DIGITS, _OTHER = re.compile(r"\d"), re.compile(r"[\W_]+")


def line_key(line: str) -> int | None:
    """Hash of a line in lower case, digits made equal, everything but letters and digits dropped; None if nothing is left."""
    plain = _OTHER.sub("", _DIGITS.sub("0", line.lower()))
    return xxhash.xxh3_64_intdigest(plain.encode()) - (1 << 63) if plain else None


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three words that the text holds twice or more."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    at = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    pair = np.unique(at[:-1] * len(codes) + at[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * len(codes) + at[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:len(words) - 2 + shift] |= again
    return int(covered.sum())


def text_figures(text: str | None) -> tuple[int, int, int, int, int, list[dict]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and each distinct line key with its words and places here."""
    text = text or ""
    words = text.encode().split()  # bytes are split at the six ASCII spaces only
    seen: set[str] = set()
    lines: dict[int, list] = {}
    duplicates = 0
    for place, line in enumerate(text.split("\n")):
        if not line.strip(SPACES):
            continue
        if line in seen:
            duplicates += 1
        seen.add(line)
        key = line_key(line)
        if key is not None:
            found = lines.setdefault(key, [0, []])
            found[0] += len(line.encode().split())
            found[1].append(place)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words),
            [{"line": k, "words": n, "places": at} for k, (n, at) in lines.items()])


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS,
                    min_left: float = MIN_LEFT) -> DataFrame:
    """id, hash (of the text), host, the five figures, words_left, removed (numbers of removed lines, from 0), base_failed, kept."""
    id_type, host_type = sql_type(docs, id_col), sql_type(docs, host_col)
    figures = cut_lineage(map_rows(
        docs.select(F.col(id_col), F.col(host_col), F.xxhash64(text_col), F.col(text_col)),
        f"id {id_type}, host {host_type}, hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long,places:array<int>>>",
        lambda key, host, code, text: (key, host, code, *text_figures(text))))
    figures = figures.select("*", text_key("id").alias("owner"), text_key("host").alias("of"))
    each = figures.select("id", "owner", "of", "hash", F.inline("lines"))
    common = each.groupBy("of", "line", "hash").agg(F.min("id").alias("id")).groupBy("of", "line").agg(F.count("*").alias("texts"), F.min("id").alias("keeper"))
    common = common.where(F.col("texts") > max_docs).select("of", "line", "keeper")
    lost = split_join(each, common, ["of", "line"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    # repeated rows (equal in id, host and text) are one here
    lost = lost.groupBy("owner", "of", "hash", "line").agg(F.first("words").alias("words"), F.first("places").alias("places"))
    lost = lost.groupBy("owner", "of", "hash").agg(F.sum("words").alias("n_lost"), F.flatten(F.collect_list("places")).alias("removed"))
    out = split_join(figures.drop("lines"), lost, ["owner", "of", "hash"], "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("n_lost", F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "hash", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", left.alias("words_left"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), failed.alias("base_failed"), (~failed & (left >= F.col("n_words") * min_left)).alias("kept"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that are kept, with all their columns, their removed lines taken out of the text."""
    verdicts = judge_documents(docs, id_col, text_col, host_col, **limits).where("kept").select(
        text_key(id_col).alias("owner"), text_key("host").alias("of"), "hash", "removed").dropDuplicates(["owner", "of", "hash"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(id_col).alias("owner"), text_key(host_col).alias("of"), F.xxhash64(text_col).alias("hash"))
    lines = F.split(F.col("row")[text_col], "\n")
    text = F.when(F.size("removed") > 0, F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed", i)), "\n")).otherwise(F.col("row")[text_col])
    return split_join(packed, verdicts, ["owner", "of", "hash"]).select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
