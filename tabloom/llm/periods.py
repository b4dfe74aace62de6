"""Periodic runs of words by seed and extend along diagonals.

A run of smallest period q and at least max(6, 4 q) words holds as many as max(6 - q, 3 q) neighbouring words that equal the
word q further on: the overlap of the run with itself. Lags are taken in classes [2**s, 2**(s + 1)); the k-grams of a class have
the least overlap that its lags guarantee, so that every run holds a k-gram at two places q apart. As k is at least q, a place
inside the run where the k-gram returns earlier would give the run a smaller period; it is therefore enough to pair each
occurrence with the next one, and the pairs of a document grow with its words, not with their square. A pair is extended in both
directions along its diagonal; a table of the furthest place covered per lag passes over the pairs of a diagonal that an earlier
extension has covered.

k-grams are compared by names, not by hashes: names of 2**s words are pairs of names of half the length. Documents without any
repeated 5-gram are done after one look.

Defined cases: a null text, and one without words, has no run and an empty collapsed text; repeated rows have equal results; very
long texts are treated whole, in one task each, with memory for a few numbers per word; null ids are kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_rows, sql_type

LEAST, TIMES = 6, 4  # a run has LEAST words and TIMES periods at least
SHORTEST = LEAST - 1  # k-gram of lag 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: the six ASCII spaces only


def names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number per pair of numbers, the same for equal pairs only."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64)


def repeated(name: np.ndarray) -> bool:
    ordered = np.sort(name)
    return bool((ordered[1:] == ordered[:-1]).any())


def next_places(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place and the next one of the same name, by place."""
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    by_place = np.argsort(a, kind="stable")
    return a[by_place], b[by_place]


def matched(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, forwards or backwards, equal the word ``lag`` further on."""
    n, block = 0, 32
    while True:
        if step > 0:
            a, b = w[at + n:at + n + block], w[at + n + lag:at + n + lag + block]
            differ = np.flatnonzero(a[:len(b)] != b)
            length = len(b)
        else:
            low = max(0, at - n - block + 1)
            differ = np.flatnonzero(w[low:at - n + 1][::-1] != w[low + lag:at - n + 1 + lag][::-1])
            length = at - n + 1 - low
        if len(differ):
            return n + int(differ[0])
        n += length
        if length < block:
            return n
        block *= 2


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in words given as numbers, by start, then period."""
    n = len(w)
    found: list[tuple[int, int, int]] = []
    if n < LEAST:
        return found
    two = names(w[:-1], w[1:])
    four = names(two[:-2], two[2:])
    if not repeated(names(four[:n - SHORTEST + 1], w[SHORTEST - 1:])):
        return found
    half, whole, s = w, two, 0  # names of 2**s and of 2**(s + 1) words
    while TIMES << s <= n:
        # the k-grams of the class: 5 words for lag 1, else 3 * 2**s
        k = SHORTEST if s == 0 else (TIMES - 1) << s
        if s == 0:
            grams = names(four[:n - k + 1], w[k - 1:])
        else:
            grams = names(whole[:n - k + 1], half[(2 << s):][:n - k + 1])
        a, b = next_places(grams)
        near = (b - a >= 1 << s) & (b - a < 2 << s)
        covered: dict[int, int] = {}
        for i, lag in zip(a[near].tolist(), (b - a)[near].tolist()):
            if i < covered.get(lag, 0):
                continue
            start = i - matched(w, i - 1, lag, -1) if i else 0
            stop = i + matched(w, i, lag, 1)
            covered[lag] = stop
            if stop - start + lag >= max(LEAST, TIMES * lag):
                found.append((start, stop - start + lag, lag))
        if not len(a):
            break  # no k-gram returns, so no longer one does
        step = 2 << s
        half, whole, s = whole, names(whole[:-step], whole[step:]) if len(whole) > step else whole[:0], s + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones the first, then the one of least period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic(text: str | None) -> tuple[list[dict], dict | None, str]:
    """All runs, the strongest, and the text without what repeats: the words that no run holds after its first period."""
    words = words_of(text)
    known: dict[bytes, int] = {}
    w = np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(words))
    runs = runs_of(w)
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    told = [dict(zip(("start", "length", "period"), r)) for r in runs]
    best = strongest(runs)
    return told, best and dict(zip(("start", "length", "period"), best)), b" ".join(words).decode()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (start, length, period in words), strongest run or null, and collapsed text, for every row."""
    run = "struct<start:long,length:long,period:long>"
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), f"id {sql_type(docs, id_col)}, runs array<{run}>, strongest {run}, collapsed string",
                    lambda key, text: (key, *periodic(text))).withColumnRenamed("id", id_col)
