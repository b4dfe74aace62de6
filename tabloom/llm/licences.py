"""Licence scan by templates and a trained passage classifier.

The words of a text are one sequence, whatever its lines: a template is confirmed where a window of words holds CONFIRMED of
its bigrams (the window is twice the template's words and 30 more). Confirmed places that overlap are one passage. The passage's
word unigrams and bigrams are scored by a logistic regression with an unknown class; the families of which the passage has a
mark are named, all of them, or without any mark the surest one that is confirmed, when the probability of the confirmed
families together passes the threshold calibrated on held-out paragraphs.

The model is fitted by the driver on the templates below, thinned and embedded in text, and on at most NEGATIVES lines of
the corpus (those with the least hash); nothing else is taken to the driver. Scoring is joins and sums of DataFrames.

Defined cases: a null or empty text names nothing; a family named twice in a document is given once; n_paragraphs counts the
lines on which a named passage ends, so a notice wrapped over lines counts once; repeated rows have equal results; an empty
table gives an empty result; null ids are kept; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import split_join
from .rows import cut_lineage, least_hashed, text_key

NEGATIVES = 1_000
CONFIRMED = 0.6  # share of a template's bigrams
FALSE_RATE = 0.002  # of held-out paragraphs without a licence
UNKNOWN = "unknown"

# How works of each family are usually marked.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["licensed under the GNU Affero General Public License", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Released under the BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License", "licensed under the Mozilla Public License, version 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["dedicated to the public domain under CC0 1.0", "the person who associated a work with this deed has dedicated the work to the public domain"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential"],
}
# Sentences that use the same words for other things.
UNRELATED = [
    "his driving license was suspended", "a fishing license costs ten dollars", "she asked for permission to leave early", "all rights and duties of the members",
    "the general public was invited", "a copy of the letter was sent to the office", "the apache people lived there", "the foundation published a version of the report",
    "reserved seats in the first row", "the software is used in many schools", "free of charge for children", "students at MIT built a robot", "civil rights were reserved for citizens",
]
# Bigrams that tell a family from those with nearly the same wording. A template that has none of its family's is
# told by any of its own.
MARKS = {
    "apache-2.0": ["the apache", "apache license"], "mit": ["the mit", "mit license"], "bsd": ["the bsd", "bsd license"], "mpl-2.0": ["the mozilla", "mozilla public"],
    "gpl": ["gnu general"], "lgpl": ["gnu lesser", "lesser general"], "agpl": ["gnu affero", "affero general"],
    "cc-by": ["by 4.0", "attribution 4.0"], "cc-by-sa": ["by sa", "attribution sharealike"], "cc-by-nc": ["by nc", "attribution noncommercial"],
}
_WORD = r"[^a-z0-9.+]+"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(_WORD, text.lower())) if w]


def grams_of(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


def template_rows() -> list[tuple[str, int, set[str]]]:
    texts = [(family, t) for family, all_ in TEMPLATES.items() for t in all_]
    return [(family, n, grams_of(words_of(t))) for n, (family, t) in enumerate(texts)]


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float


def fit(negatives: list[str], seed: int = 3, steps: int = 300, rate: float = 2.0, penalty: float = 1e-4) -> Model:
    """Multinomial logistic regression by full gradient steps on the bounded training rows. A quarter of the rows without a
    licence is held out and sets the threshold."""
    random = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    own = [grams for _, _, grams in template_rows()]
    plain = [words_of(t) for t in UNRELATED] + [w for w in map(words_of, negatives) if max(len(g & grams_of(w)) / len(g) for g in own) < 0.3]
    held = plain[3::4]
    fill = [w for k, w in enumerate(plain) if k % 4 != 3] or [words_of(t) for t in UNRELATED]
    rows = [(grams_of(w), UNKNOWN) for w in fill]
    for family, all_ in TEMPLATES.items():
        for words in map(words_of, all_):
            rows.append((grams_of(words), family))
            for _ in range(40 // len(all_)):
                kept = [w for w in words if random.random() > 0.1] or words
                around = fill[random.integers(len(fill))]
                cut = int(random.integers(0, len(around) + 1))
                rows.append((grams_of([*around[:cut][-8:], *kept, *around[cut:][:8]]), family))
    vocabulary = {g: k for k, g in enumerate(sorted(set().union(*own) | {g for t in UNRELATED for g in grams_of(words_of(t))}))}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    y = np.zeros((len(rows), len(families)))
    for k, (grams, family) in enumerate(rows):
        x[k, [vocabulary[g] for g in grams if g in vocabulary]] = 1
        y[k, families.index(family)] = 1
    w = np.zeros((x.shape[1], len(families)))
    w[-1, -1] = 1.0
    share = 1 / y.sum(axis=0)[y.argmax(axis=1)]  # classes weigh the same
    for _ in range(steps):
        p = x @ w
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (x.T @ ((p - y) * share[:, None]) / len(families) * 4 + penalty * w)
    scores = []
    for words in held:
        s = w[-1] + sum((w[vocabulary[g]] for g in grams_of(words) if g in vocabulary), np.zeros(len(families)))
        e = np.exp(s - s.max())
        scores.append(float((e[:-1] / e.sum()).max()))
    threshold = max(0.5, float(np.quantile(scores, 1 - FALSE_RATE))) if scores else 0.5
    return Model(families, {g: w[k].tolist() for g, k in vocabulary.items()}, w[-1].tolist(), min(threshold, 0.95))


def words_column(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(paragraph, _WORD), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def holds(text: Column, words: list[str]) -> Column:
    """Whether a text has the letters of any of the words."""
    return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in words]))


def templates() -> list[dict]:
    """number, family, grams (bigrams), marks, need (bigrams that confirm), reach (words in which they must lie)."""
    out = []
    for number, (family, text) in enumerate((f, t) for f, all_ in TEMPLATES.items() for t in all_):
        words = words_of(text)
        grams = sorted(set(map(" ".join, zip(words, words[1:]))))
        own = sorted(set(MARKS.get(family, [])) & set(grams))
        out.append({"number": number, "family": family, "grams": grams, "marks": own or grams, "need": ceil(CONFIRMED * len(grams) - 1e-9), "reach": 2 * len(words) + 30})
    return out


def gates() -> list[tuple[list[str], list[str], int]]:
    """(cover, words, least) per template. A text that holds ``need`` of the template's bigrams holds a word of ``cover``, as fewer
    than ``need`` bigrams are without one, and ``least`` of its ``words``, as fewer words have not so many bigrams between them."""
    out, chosen = [], set()
    for t in templates():
        grams = [set(g.split(" ")) for g in t["grams"]]
        words, cover, open_ = sorted(set().union(*grams)), [], grams
        for w in sorted(words, key=lambda w: (w not in chosen, -len(w), w)):
            if len(open_) < t["need"]:
                break
            if len(w) > 3 and any(w in g for g in open_):
                cover.append(w)
                open_ = [g for g in open_ if w not in g]
        if len(open_) >= t["need"]:
            cover = words
        ends = sorted((sum(2 if len(g) == 1 else 1 for g in grams if w in g) for w in words), reverse=True)
        least = next(k for k in range(1, len(words) + 1) if sum(ends[:k]) >= 2 * t["need"])
        chosen.update(cover)
        out.append((cover, words, least))
    return out


def covers() -> list[str]:
    return sorted({w for cover, _, _ in gates() for w in cover})


def may_confirm(text: Column) -> Column:
    """Whether a text has the letters of so many words of a template that the template could be confirmed in it."""
    def passes(t: Column, cover: list[str], words: list[str], least: int) -> Column:
        return reduce(or_, [F.contains(t, F.lit(w)) for w in cover]) & (sum((F.contains(t, F.lit(w)).cast("int") for w in words[1:]), F.contains(t, F.lit(words[0])).cast("int")) >= least)
    return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [passes(t, *g) for g in gates()]))


def passages(text: Column) -> Column:
    """Array of (start, stop, line, families, own) for the places of a text where templates are confirmed: a template's bigrams
    are counted in windows of words that run across line ends; passages that overlap are one. ``own`` are the families of which
    a mark was found, ``line`` is the one on which the passage ends, words are counted from 0."""
    known = templates()
    table = F.array(*[F.struct(F.lit(t["family"]).alias("family"), F.array(*map(F.lit, t["grams"])).alias("grams"), F.array(*map(F.lit, t["marks"])).alias("marks"),
                               F.lit(t["need"]).alias("need"), F.lit(t["reach"]).alias("reach")) for t in known])
    every = sorted({g for t in known for g in t["grams"]})

    def hits(tokens: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda k: F.struct(
            k.alias("at"), tokens[k + 1]["line"].alias("line"), F.concat_ws(" ", tokens[k]["word"], tokens[k + 1]["word"]).alias("gram")))
        return F.when(F.size(tokens) > 1, F.filter(pairs, lambda p: p["gram"].isin(every)))

    def window(own: Column, k: Column, reach: Column) -> Column:
        """From hit k: the bigrams met, and where the last new one was."""
        begin = F.struct(F.array().cast("array<string>").alias("met"), own[k]["at"].alias("start"), own[k]["at"].alias("stop"), own[k]["line"].alias("line"))
        near = F.filter(F.slice(own, k + 1, reach), lambda h: h["at"] < own[k]["at"] + reach)
        return F.aggregate(near, begin, lambda w, h: F.when(F.array_contains(w["met"], h["gram"]), w).otherwise(F.struct(
            F.concat(w["met"], F.array(h["gram"])).alias("met"), w["start"].alias("start"), (h["at"] + 1).alias("stop"), h["line"].alias("line"))))

    def places(found: Column, t: Column) -> Column:
        """Windows that confirm, from the left, without those that a later start makes shorter at no loss."""
        own = F.filter(found, lambda h: F.array_contains(t["grams"], h["gram"]))
        none = F.array().cast("array<struct<start:int,stop:int,line:int,families:array<string>,own:array<string>>>")
        length = lambda w: w["stop"] - w["start"]

        def choose(windows: Column) -> Column:
            good = F.filter(windows, lambda w, k: (F.size(w["met"]) >= t["need"]) & ~F.coalesce(
                (F.size(F.get(windows, k + 1)["met"]) >= F.size(w["met"])) & (length(F.get(windows, k + 1)) <= length(w)), F.lit(False)))
            return F.aggregate(good, none, lambda done, w: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] > w["start"]), done).otherwise(F.concat(done, F.array(F.struct(
                w["start"].alias("start"), w["stop"].alias("stop"), w["line"].alias("line"), F.array(t["family"]).alias("families"),
                F.when(F.arrays_overlap(w["met"], t["marks"]), F.array(t["family"])).otherwise(F.array().cast("array<string>")).alias("own"))))))

        return let(own, lambda o: let(F.transform(F.sequence(F.lit(0), F.size(o) - 1), lambda k: window(o, k, t["reach"])), choose))

    def merge(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["stop"], p["stop"]).alias("stop"), F.greatest(last["line"], p["line"]).alias("line"),
                        F.array_union(last["families"], p["families"]).alias("families"), F.array_union(last["own"], p["own"]).alias("own"))
        return F.when((F.size(done) > 0) & (last["stop"] >= p["start"]) & (last["line"] == p["line"]) | (last["stop"] > p["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(p)))

    def of(tokens: Column) -> Column:
        def confirmed(found: Column) -> Column:
            met = F.array_distinct(F.transform(found, lambda h: h["gram"]))
            able = F.filter(table, lambda t: F.size(F.array_intersect(met, t["grams"])) >= t["need"])
            all_ = F.array_sort(F.flatten(F.transform(able, lambda t: places(found, t))))
            begin = F.array().cast("array<struct<start:int,stop:int,line:int,families:array<string>,own:array<string>>>")
            merged = F.aggregate(all_, begin, merge)
            return F.transform(merged, lambda p: F.struct(p["line"].alias("place"), p["start"].alias("start"), p["families"].alias("families"), p["own"].alias("own"),
                                                          F.transform(F.slice(tokens, p["start"] + 1, p["stop"] - p["start"] + 1), lambda x: x["word"]).alias("words")))
        return let(hits(tokens), confirmed)

    tokens = F.flatten(F.transform(F.split(F.lower(text), "\n"), lambda line, n: F.transform(words_column(line), lambda w: F.struct(w.alias("word"), n.alias("line")))))
    return let(tokens, of)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """owner, hash, place, family, probability for the passages of known families. The probability is that of the families
    confirmed in the passage together."""
    spark = docs.sparkSession
    rows = docs.where(holds(F.col(text_col), covers()) & may_confirm(F.col(text_col)))
    if model is None:
        lines = rows.select(F.explode(F.split(text_col, "\n")).alias("paragraph")).where(holds(F.col("paragraph"), covers()))
        marked = cut_lineage(lines.distinct())
        model = fit(sorted(r["paragraph"] for r in least_hashed(marked, ["paragraph"], NEGATIVES).collect()))
    found = rows.select(text_key(id_col).alias("owner"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"), F.inline(passages(F.col(text_col))))
    found = cut_lineage(found)
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda k: F.concat_ws(" ", F.col("words")[k], F.col("words")[k + 1]))
    grams = F.array_distinct(F.concat("words", pairs))
    keys = ["row", "owner", "hash", "place", "start", "families", "own"]
    marks = found.select(*keys, F.explode(grams).alias("gram"))

    # one row per string of the bounded vocabulary: its weights
    rows = json.dumps([{"gram": g, "weights": w} for g, w in model.weights.items()])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<gram:string,weights:array<double>>>")))
    met = marks.join(F.broadcast(table), "gram")
    scored = met.groupBy(*keys).agg(*[F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(len(model.families))])
    scores = F.array(*[F.col(f"s{k}") + b for k, b in enumerate(model.bias)])
    names, n = F.array(*map(F.lit, model.families)), len(model.families) - 1

    def verdict(p: Column) -> Column:
        """Families named, and the probability of the confirmed ones together."""
        total, best = F.aggregate(p, F.lit(0.0), lambda t, x: t + x), F.array_max(F.slice(p, 1, n))
        sure = F.filter(names, lambda f, k: (k < n) & (F.get(p, k) == best) & F.array_contains("families", f))
        shares = F.zip_with(p, names, lambda x, f: F.when(F.array_contains("families", f), x).otherwise(0.0))
        # without any mark the surest family decides, if it is one of the confirmed
        return F.struct(F.when(F.size("own") > 0, F.col("own")).otherwise(sure).alias("named"), (F.aggregate(shares, F.lit(0.0), lambda t, x: t + x) / total).alias("probability"))

    out = scored.select("owner", "hash", "place", let(let(scores, lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))), verdict).alias("v"))
    return out.where(F.col("v.probability") >= model.threshold).select("owner", "hash", "place", F.explode("v.named").alias("family"), F.col("v.probability").alias("probability"))


def document_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id, families (in order), n_paragraphs, probability (of the surest) for every row."""
    hits = scan(docs, id_col, text_col, model).groupBy("owner", "hash").agg(
        F.sort_array(F.collect_set("family")).alias("families"), F.count_distinct("place").alias("n_paragraphs"), F.max("probability").alias("probability"))
    rows = docs.select(F.col(id_col), text_key(id_col).alias("owner"), F.xxhash64(text_col).alias("hash"))
    out = split_join(rows, hits, ["owner", "hash"], "left")
    return out.select(id_col, F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), "probability")
