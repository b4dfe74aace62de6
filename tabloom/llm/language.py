"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are combined per page: the likelihood of its text under letter models, the language its markup
declares, the suffix of its address, and a prior of its host. The last three are learnt from all pages by grouped aggregation
of the languages their texts point to; a page's own vote is taken out of what it is judged by. Host priors are smoothed
towards the registered domain, that towards all pages.

The letter models are fitted on at most TRAIN_ROWS labelled documents (those with the least hash of their id), whole texts, and
hold at most FEATURES strings of up to GRAM letters; every page is scored on its whole text.

Defined cases: a null or empty page has no text evidence, and its address and declaration decide; a null url has the empty
host; repeated pages vote each; without labelled documents the result's language is null; an empty table gives an empty
result; null ids are kept; other columns are not read. Ties go to the language first in order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import split_join
from .rows import cut_lineage, least_hashed, map_batches, sql_type

TRAIN_ROWS = 2_000
FEATURES = 6_000
GRAM = 3
TEMPER = 0.1  # letters of a text are not independent; their log-likelihood is scaled
SMOOTHING = 5.0  # votes that a higher level is worth
LEAST_GRAMS = 30  # strings a text needs to vote

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def visible_text(page: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def declared_language(page: str | None) -> str:
    found = _DECLARED.search(page or "")
    return found[1].lower() if found else ""


def grams(text: str) -> Counter:
    text = f" {_NOT_LETTERS.sub(' ', text.lower())} "
    out: Counter = Counter(text)
    for n in range(2, GRAM + 1):
        out.update(map("".join, zip(*(text[k:] for k in range(n)))))
    out.pop(" ", None)
    return out


def letter_models(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages in order, and the log-probability of each kept string under each."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = least_hashed(known, [id_col], TRAIN_ROWS).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[str, Counter] = {}
        for lang, text in rows:
            sums.setdefault(lang, Counter()).update(grams(text))
        for lang, found in sums.items():
            yield from ((lang, g, n) for g, n in found.items())

    counts = cut_lineage(map_batches(sample.select("lang", "text"), "lang string, gram string, n long", count).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(FEATURES)
    kept = counts.join(F.broadcast(best), "gram").select("lang", "gram", "n").collect()  # FEATURES strings in each language at most
    langs = sorted({r["lang"] for r in kept})
    table = {g: np.full(len(langs), 0.5) for g in {r["gram"] for r in kept}}
    for r in kept:
        table[r["gram"]][langs.index(r["lang"])] += r["n"]
    totals = sum(table.values()) if table else np.ones(0)
    return langs, {g: np.log(n / totals) for g, n in table.items()}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://(?:[^/?#]*@)?([^/?#:]*)", 1))


def votes(seen: DataFrame, key: str, n: int) -> DataFrame:
    """For each value of a column, the votes for each language; one partial sum per value and task."""
    sums = [F.sum(F.when(F.col("vote") == k, 1).otherwise(0)).alias(f"v{k}") for k in range(n)]
    return seen.groupBy(key).agg(*sums).select(key, F.array(*[F.col(f"v{k}").cast("double") for k in range(n)]).alias(f"{key}_votes"))


def identify(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, declared, text_language, language, confidence for every page."""
    langs, model = letter_models(labelled)
    n = len(langs)
    seen = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    if not n:
        return seen.select(F.col("id").alias(id_col), "host", *[F.lit(None).cast("string").alias(c) for c in ("declared", "text_language", "language")], F.lit(None).cast("double").alias("confidence"))
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = sent.value
        for key, host, page in rows:
            total, met = np.zeros(n), 0
            for g, times in grams(visible_text(page)).items():
                p = known.get(g)
                if p is not None:
                    total += times * p
                    met += times
            vote = int(total.argmax()) if met >= LEAST_GRAMS else None
            yield key, host, declared_language(page), vote, (TEMPER * (total - total.max())).tolist()

    seen = map_batches(seen, f"id {sql_type(pages, id_col)}, host string, declared string, vote int, text array<double>", read)
    labels = F.split("host", r"\.")
    seen = cut_lineage(seen.select("*", F.element_at(labels, -1).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain")))

    every = seen.agg(*[F.sum(F.when(F.col("vote") == k, 1).otherwise(0)) for k in range(n)]).first()  # one number per language
    world = [float(v or 0) for v in every]
    base = [(v + 1.0) / (sum(world) + n) for v in world]
    for key in ("suffix", "declared", "domain", "host"):
        seen = split_join(seen, votes(seen, key, n), key)

    def smoothed(own: list[Column], above: list[Column]) -> list[Column]:
        total = sum(own[1:], own[0]) + SMOOTHING
        return [(v + SMOOTHING * p) / total for v, p in zip(own, above)]

    def others(key: str) -> list[Column]:
        return [F.col(f"{key}_votes")[k] - F.when(F.col("vote") == k, 1.0).otherwise(0.0) for k in range(n)]

    prior = smoothed(others("host"), smoothed(others("domain"), [F.lit(b) for b in base]))
    scores = []
    for k in range(n):
        # how likely the declaration and the suffix are under the language, up to a factor equal for all languages
        said = [(others(key)[k] + SMOOTHING * base[k]) / (world[k] + SMOOTHING) / base[k] for key in ("declared", "suffix")]
        scores.append(F.col("text")[k] + F.log(prior[k]) + F.log(said[0]) + F.log(said[1]))
    seen = seen.withColumn("scores", F.array(*scores)).withColumn("top", F.array_max("scores"))
    names = F.array(*map(F.lit, langs))
    weight = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))
    return seen.select(
        F.col("id").alias(id_col), "host", "declared", F.when(F.col("vote").isNotNull(), F.element_at(names, F.col("vote") + 1)).alias("text_language"),
        F.element_at(names, F.array_position("scores", F.col("top")).cast("int")).alias("language"), (1 / weight).alias("confidence"))
