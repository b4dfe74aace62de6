"""Removal of repeated passages by hash-compared suffix sorting.

A byte goes when it lies in a string of LENGTH bytes that also starts anywhere else. Only suffixes that can share so many bytes
are sorted, and they meet in small groups:

1. Each window of LENGTH bytes names one anchor, its leftmost least hash of GRAM bytes, so equal windows name equal anchors. An
   anchor that occurs once proves its windows unique; a thin table of anchor hashes finds the others.
2. Around the others, every STEP window starts share a core of LENGTH - STEP + 1 bytes. Starts meet by a 128-bit digest of it.
3. In a group, the suffixes are put in order by mergesort. Two suffixes are compared through their common extension, found by
   binary search over prefix polynomial hashes; neighbours whose extension covers the window are confirmed on the bytes.

A group larger than BLOCK is cut into blocks that are sorted on their own; one of each different window of a block is then
counted by digest over all blocks, so a passage in a third of all documents is spread over tasks and no repeat is lost.

Defined cases: a null text is an empty one; texts shorter than LENGTH lose nothing; equal texts of at least LENGTH bytes lose
everything, each being elsewhere; repeated rows are copies; null ids are kept; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .graph import split_join
from .minhash import mixed
from .rows import map_batches, map_rows, sql_type

LENGTH = 400
GRAM = 200
STEP = 64
BLOCK = 512
PART = 400_000  # bytes of a text worked on at a time
AT_ONCE = 20_000  # suffix strings sorted together

_random = np.random.default_rng(77)
_LETTERS = _random.integers(1, 1 << 63, 256, np.uint64)
_BASE = _random.integers(1, 1 << 63, 1, np.uint64)[0] * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 20) - 1)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1, modulo 2 ** 64."""
    if n not in _POWERS:
        p = np.full(n, _BASE, np.uint64)
        p[0] = 1
        _POWERS[n] = np.cumprod(p)
    return _POWERS[n]


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(v) - width + 1
    blocks = np.concatenate([v, np.full(-len(v) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (gram hash, place, first window start, last window start) for parts of the text."""
    whole = np.frombuffer(text, np.uint8)
    top = powers(PART + LENGTH)
    for start in range(0, len(whole) - LENGTH + 1, PART):
        part = whole[start:start + PART + LENGTH - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[part] * top[:n], out=sums[1:])
        grams = n - GRAM + 1
        v = mixed((sums[GRAM:] - sums[:grams]) * top[PART + LENGTH - grams:][::-1])
        least = sliding_least((v & ~_LOW) | np.arange(grams, dtype=np.uint64), LENGTH - GRAM + 1)
        at = (least & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        place = at[first]
        yield v[place].view(np.int64), place + start, first + start, last + start


def extension(sums: np.ndarray, top: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of what the suffixes at p and q have in common: where the hashes over ``most`` bytes differ, binary
    search over equality of prefix hashes."""
    far = len(top) - 1
    up, uq, sp, sq = top[far - p], top[far - q], sums[p], sums[q]
    common = np.where((sums[p + most] - sp) * up == (sums[q + most] - sq) * uq, most, 0)
    rest = np.flatnonzero(common < most)
    p, q, up, uq, sp, sq = (x[rest] for x in (p, q, up, uq, sp, sq))
    low, high = np.zeros(len(p), np.int64), np.full(len(p), most - 1)
    while True:
        open_ = low < high
        if not open_.any():
            common[rest] = low
            return common
        middle = (low + high + 1) // 2
        equal = (sums[p + middle] - sp) * up == (sums[q + middle] - sq) * uq
        low = np.where(open_ & equal, middle, low)
        high = np.where(open_ & ~equal, middle - 1, high)


def sort_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (start, in groups that lie together), each group on its own, and whether each equals its
    predecessor in that order over ``most`` bytes. Bottom-up mergesort; all runs of a level are merged at once, a suffix of
    a left run finding its place in the right run by binary search."""
    top = powers(1 << max(16, int(len(text)).bit_length()))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_LETTERS[text] * top[:len(text)], out=sums[1:])
    n = len(start)
    order = np.arange(n)
    begin = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    size = np.diff(np.append(begin, n))
    within = np.arange(n) - np.repeat(begin, size)
    begin, size = np.repeat(begin, size), np.repeat(size, size)

    def greater(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = start[a], start[b]
        common = extension(sums, top, p, q, most)
        differ = common < most
        at = np.minimum(common, most - 1)
        return differ & (text[p + at] > text[q + at])

    width = 1
    while width < (size.max() if n else 0):
        run = within // (2 * width) * (2 * width)
        left = np.flatnonzero((within - run < width) & (run + width < size))
        base = begin[left] + run[left] + width
        length = np.minimum(size[left] - run[left] - width, width)
        low, high = np.zeros(len(left), np.int64), length.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            is_greater = greater(order[left[open_]], order[base[open_] + middle])
            low[open_] = np.where(is_greater, middle + 1, low[open_])
            high[open_] = np.where(is_greater, high[open_], middle)
        moved = np.full(n, -1, np.int64)
        to = np.arange(n)
        to[left] += low
        is_left = np.zeros(n, bool)
        is_left[left] = True
        is_right = (within - run >= width)
        rest = ~is_left & ~is_right
        moved[to[is_left | rest]] = order[is_left | rest]
        moved[moved < 0] = order[is_right]
        order, width = moved, width * 2
    same = np.zeros(n, bool)
    if n > 1:
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(group[a] == group[b])
        near = near[extension(sums, top, start[a[near]], start[b[near]], most) == most]
        # confirmed on the bytes
        view = np.lib.stride_tricks.sliding_window_view(text, most)
        for k in range(0, len(near), 50_000):
            block = near[k:k + 50_000]
            same[block[(view[start[a[block]]] == view[start[b[block]]]).all(axis=1)] + 1] = True
    return order, same


def starts_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From texts with their shared anchors: for each STEP window starts (core digest, text, base, first, last, both margins).
    The margins are the STEP - 1 bytes before and after the core; where the text has no such byte they are padded."""
    for t1, t2, found, text in rows:
        data = text.encode()
        for _, place, first, last in sorted({tuple(f.values()) for f in found}, key=lambda f: f[2]):
            for piece in range((first - place) // STEP, (last - place) // STEP + 1):
                base = place + piece * STEP
                low, high = max(first - base, 0), min(last - base, STEP - 1)
                core = xxhash.xxh3_128_digest(data[base + STEP - 1:base + LENGTH], seed=piece % 64)
                left, right = data[base + low:base + STEP - 1], data[base + LENGTH:base + high + LENGTH]
                yield (int.from_bytes(core[:8], "little", signed=True), int.from_bytes(core[8:], "little", signed=True), t1, t2, base, low, high,
                       left.rjust(STEP - 1, b"\0") + right.ljust(STEP - 1, b"\0"))


def repeats_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From pieces (core, block, blocks, text, base, first, last, margins), groups lying together: spans (text, start, stop) of
    repeated windows, and for groups of several blocks one of each different window (text, start, digest)."""
    held: list[tuple] = []
    for row in rows:
        if len(held) >= AT_ONCE and row[:3] != held[-1][:3]:
            yield from sorted_repeats(held)
            held = []
        held.append(row)
    if held:
        yield from sorted_repeats(held)


def sorted_repeats(rows: list[tuple]) -> Iterator[tuple]:
    window = STEP - 1
    text = np.frombuffer(b"".join(r[-1] for r in rows), np.uint8)
    numbers: dict[tuple, int] = {}
    group = np.array([numbers.setdefault(r[:3], len(numbers)) for r in rows])
    low, high = (np.array([r[k] for r in rows]) for k in (7, 8))
    # a suffix for each start of each piece, those of one group and one place side by side
    piece = np.repeat(np.arange(len(rows)), high - low + 1)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[piece]
    key = group[piece] * STEP + place
    by = np.argsort(key, kind="stable")
    piece, place, key = piece[by], place[by], key[by]
    order, same = sort_suffixes(text, piece * (2 * window) + place, key, window)
    equal = np.zeros(len(order), bool)
    equal[order[same]] = True
    equal[order[:-1][same[1:]]] = True
    first = np.zeros(len(order), bool)
    first[order[~same]] = True
    back = np.lexsort((place, piece))
    piece, place, equal, first = piece[back], place[back], equal[back], first[back]
    at = np.flatnonzero(equal)
    if len(at):
        cut = np.flatnonzero((np.diff(piece[at]) != 0) | (np.diff(place[at]) != 1)) + 1
        a, b = at[np.concatenate([[0], cut])], at[np.append(cut, len(at)) - 1]
        for k, start, stop in zip(piece[a].tolist(), place[a].tolist(), place[b].tolist()):
            r = rows[k]
            yield r[4], r[5], r[6] + start, r[6] + stop + LENGTH, None, None
    # of each different window one goes on, where other blocks may hold its equal
    for k in np.flatnonzero(first):
        r = rows[piece[k]]
        if r[3] > 1:
            j = int(place[k])
            code = xxhash.xxh3_128_digest(r[-1][j:j + window] + j.to_bytes(1, "little") + r[0].to_bytes(8, "little", signed=True) + r[1].to_bytes(8, "little", signed=True))
            yield r[4], r[5], int(r[6] + j), int(r[6] + j + LENGTH), int.from_bytes(code[:8], "little", signed=True), int.from_bytes(code[8:], "little", signed=True)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, spans (removed, as byte positions start and stop), kept (the bytes that stay) for every row."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))

    def anchors_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for t1, t2, value in rows:
            for arrays in anchors(value.encode()):
                for found in zip(*(x.tolist() for x in arrays)):
                    yield t1, t2, *found

    path = scratch_path(spark, "anchors")
    map_batches(texts.select("t1", "t2", "text"), "t1 long, t2 long, gram long, place int, first int, last int", anchors_of).write.parquet(path)
    found = spark.read.parquet(path)
    # equal texts are one here: an anchor is shared if it stands at two places of different texts or of one text
    occurrence = F.xxhash64("t1", "t2", "place")
    shared = found.groupBy("gram").agg(F.min(occurrence).alias("low"), F.max(occurrence).alias("high")).where("low <> high").select("gram")
    candidates = split_join(found, shared, "gram", "left_semi").groupBy("t1", "t2").agg(F.collect_set(F.struct("gram", "place", "first", "last")).alias("found"))
    one = texts.select("t1", "t2", F.xxhash64("id").alias("who"), F.octet_length("text").alias("bytes")).groupBy("t1", "t2").agg(F.min("who").alias("who"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"))
    chosen = one.join(candidates, ["t1", "t2"]).select("t1", "t2", "who", "found")
    read = texts.withColumn("who", F.xxhash64("id")).join(chosen, ["t1", "t2", "who"]).select("t1", "t2", "found", "text")
    pieces_path = scratch_path(spark, "pieces")
    map_batches(read, "c1 long, c2 long, t1 long, t2 long, base int, low int, high int, margins binary", starts_of).write.parquet(pieces_path)
    pieces = spark.read.parquet(pieces_path)
    groups = pieces.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = split_join(pieces, groups, ["c1", "c2"]).withColumn("block", F.pmod(F.xxhash64("t1", "t2", "base"), F.col("blocks")).cast("int"))
    met = met.select("c1", "c2", "block", "blocks", "t1", "t2", "base", "low", "high", "margins").repartition("c1", "c2", "block")
    met = met.sortWithinPartitions("c1", "c2", "block", "t1", "t2", "base")
    spans_path = scratch_path(spark, "spans")
    map_batches(met, "t1 long, t2 long, start int, stop int, w1 long, w2 long", repeats_of).write.parquet(spans_path)
    spans = spark.read.parquet(spans_path)
    rest = spans.where("w1 is not null")
    twice = rest.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    late = split_join(rest, twice, ["w1", "w2"], "left_semi")
    copies = one.where((F.col("copies") > 1) & (F.col("bytes") >= LENGTH)).select("t1", "t2", F.lit(0).alias("start"), F.col("bytes").cast("int").alias("stop"))
    every = spans.where("w1 is null").select("t1", "t2", "start", "stop").unionByName(late.select("t1", "t2", "start", "stop")).unionByName(copies)
    every = every.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    out = split_join(texts, every, ["t1", "t2"], "left")

    def cut(key, value: str, spans: list | None) -> tuple:
        data = value.encode()
        merged: list[list[int]] = []
        for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        ends = [0, *(x for m in merged for x in m), len(data)]
        return key, len(data), [{"start": a, "stop": b} for a, b in merged], b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))

    return map_rows(out.select("id", "text", "found"), f"`{id_col}` {sql_type(docs, id_col)}, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary", cut)
