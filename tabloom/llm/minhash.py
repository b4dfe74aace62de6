"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets are one class. Classes meet in band buckets of their signatures; a pair is compared one
batch of signature values after the other and dropped as soon as the posterior probability of a similarity at or above the
threshold, under a flat prior, is below ``MISS``; survivors are verified on full sets.

No bucket is expanded into its pairs: first every class is compared with the least class of its buckets only, and the links
found make components. Buckets that then still hold several components are cut into blocks, and every two blocks are one piece
of work in which the classes of different components are compared. A piece returns the classes that have some candidate left,
one row each; their full sets meet in the same piece again, cut to a number of shingles, where candidates are found anew and
verified. Only links that join something leave it; pairs never do.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; with fewer words than a
shingle the whole text is one shingle; equal rows share their result; a component whose ids are all null has a null id and
its least class is kept; an empty table gives an empty result; other columns are not read. Shingles and classes are told
apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, merged, split_join, with_roots
from .rows import cut_lineage, map_batches, sql_type, text_key

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4  # a pair at the threshold misses all bands with probability 5e-6
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-5
BLOCK = 1024  # classes of a bucket that are compared with another block, or with each other, in one piece
STEP = 256  # signatures compared at once
HELD = 1 << 20  # shingles of a side that a verifying task holds
KNOWN_WORDS = 200_000

_seeds = np.random.default_rng(20240607)
_FACTORS = _seeds.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _seeds.integers(0, 1 << 63, HASHES, np.uint64)
_PLACES = _seeds.integers(1, 1 << 63, max(WORDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct shingle hashes of a text; keeps the hashes of words it has met, up to a number."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces only
        if not words:
            return np.empty(0, np.uint64)
        known, code = self.known, xxhash.xxh3_64_intdigest
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = code(w)
        at = np.array([known[w] for w in words], np.uint64)
        n = len(at) - WORDS + 1
        if n < 1:
            return mixed(np.array([(at * _PLACES[:len(at)]).sum() + np.uint64(len(at))], np.uint64))
        h = at[:n] * _PLACES[0]
        for k in range(1, WORDS):
            h = h + at[k:n + k] * _PLACES[k]
        return np.unique(mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The high halves of the least value of each of HASHES permutations."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 256):
        block = np.multiply.outer(shingles[start:start + 256], _FACTORS)
        block += _SHIFTS
        np.minimum(least, block.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band, for signatures in rows."""
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mixed((parts * _PLACES[:ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each number of batches, the matches below which the posterior of similarity >= percent is under ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= percent / 100
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        for m in range(k + 1):
            log = m * np.log(grid) + (k - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[high].sum() >= miss * weight.sum():
                break
        out.append(m)
    return out


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        shingles = Shingler()
        for key, code, text in rows:
            found = shingles(text)
            if len(found):
                sig = signature(found)
                yield key, code, len(found), xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63), bands(sig)[0].tolist(), sig.tobytes()
            else:
                yield key, code, 0, None, None, None

    return map_batches(docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)),
                       f"id {sql_type(docs, id_col)}, hash long, n_shingles long, c long, bands array<long>, sig binary", run)


def surviving(sa: np.ndarray, sb: np.ndarray, a: np.ndarray, b: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (row of sa, row of sb) no batch drops, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, limit in enumerate(limits):
        at = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (sa[a[alive], at] == sb[b[alive], at]).sum(axis=1)
        keep = matches >= limit
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def promising(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that survive all batches, with their matches; ``sigs`` is (c, n, sig)."""
    limits = least_matches(percent)
    left = split_join(pairs.withColumnRenamed("a", "c"), sigs.select("c", F.col("n").alias("na"), F.col("sig").alias("sa")), "c").withColumnRenamed("c", "a")
    full = split_join(left.withColumnRenamed("b", "c"), sigs.select("c", F.col("n").alias("nb"), F.col("sig").alias("sb")), "c").withColumnRenamed("c", "b")
    full = full.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            rows = np.arange(batch.num_rows)
            alive, matches = surviving(sa, sb, rows, rows, limits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(matches)], ["a", "b", "matches"])

    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, matches long")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two ordered runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity; ``sets`` is (c, shingles)."""
    left = split_join(pairs.select(F.col("a").alias("c"), "b"), sets.select("c", F.col("shingles").alias("xa")), "c").withColumnRenamed("c", "a")
    full = split_join(left.withColumnRenamed("b", "c"), sets.select("c", F.col("shingles").alias("xb")), "c").withColumnRenamed("c", "b")

    def close(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, xa, xb in rows:
            if alike(np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64), percent):
                yield a, b

    return map_batches(full.select("a", "b", "xa", "xb"), "a long, b long", close)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, hash (of the text), n_shingles, component_id (least id of the component), kept for every row."""
    figures = cut_lineage(features(docs, id_col, text_col))
    seen = figures.where("c is not null")
    members = seen.select("c", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    # buckets of one class only have nothing to compare
    buckets = cut_lineage(members.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("greatest")).where("least <> greatest").select("band", "least"))
    shared = cut_lineage(split_join(members, buckets, "band").distinct())

    # signature and set of each class that shares a bucket, from one of its documents
    owner = seen.groupBy("c").agg(F.min(F.struct(text_key("id").alias("owner"), "hash")).alias("one"))
    nodes = cut_lineage(split_join(owner, shared.select("c").distinct(), "c", "left_semi").select("c", "one.owner", "one.hash"))
    texts = docs.select(text_key(id_col).alias("owner"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).join(nodes, ["owner", "hash"])

    def sets_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        shingles = Shingler()
        for c, text in rows:
            found = shingles(text)
            yield c, len(found), signature(found).tobytes(), found.tobytes()

    classes = cut_lineage(map_batches(texts.select("c", "text"), "c long, n long, sig binary, shingles binary", sets_of).dropDuplicates(["c"]))

    near = cut_lineage(promising(shared.where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b")).distinct(), classes.drop("shingles"), percent))
    # the most alike first; others only where that leaves two components
    first = near.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("best")).select("a", "best.b")
    of = cut_lineage(components(verified(first, classes, percent)))
    of = merged(of, verified(across(near.select("a", "b"), of), classes, percent))
    of = merged(of, joining_links(shared, of, classes, percent)).select(F.col("node").alias("c"), "root")

    ids = split_join(seen.groupBy("c").agg(F.min("id").alias("id")), of, "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = split_join(ids.select("c", "root"), ids.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    out = split_join(figures.select("id", "hash", "n_shingles", "c"), named, "c", "left")
    alone = F.col("c").isNull()
    kept = F.when(alone, True).when(F.col("component_id").isNull(), F.col("c") == F.col("root")).otherwise(F.col("id").eqNullSafe(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "hash", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"))


def across(pairs: DataFrame, of: DataFrame) -> DataFrame:
    return with_roots(pairs, of).where("ra <> rb").select("a", "b")


def pieces_of(rows: Iterator[tuple], width: int = 3) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that lie together by their first columns."""
    at, held = None, []
    for row in rows:
        if row[:width] != at:
            if held:
                yield at, held
            at, held = row[:width], []
        held.append(row[width:])
    if held:
        yield at, held


def open_pairs(classes: dict[str, np.ndarray], band: int, inside: bool, limits: list[int], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (a, b, matches) of a piece, as places in its arrays, from one square of STEP by STEP pairs after the other: of
    different components, of sizes that allow the similarity, dropped by no batch, and in their first common bucket."""
    root, n, sig, own, first = (classes[k] for k in ("root", "n", "sig", "own", "first"))
    left, right = np.flatnonzero(first), np.flatnonzero(first if inside else ~first)
    for x in range(0, len(left), STEP):
        for y in range(x if inside else 0, len(right), STEP):
            a, b = (z.ravel() for z in np.meshgrid(left[x:x + STEP], right[y:y + STEP], indexing="ij"))
            may = (root[a] != root[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
            if inside:
                may &= a < b
            a, b = a[may], b[may]
            if not len(a):
                continue
            alive, matches = surviving(sig, sig, a, b, limits)
            a, b = a[alive], b[alive]
            common = own[a] == own[b]
            here = own[a, common.argmax(axis=1)] == band
            yield a[here], b[here], matches[here]


def of_piece(held: list[tuple], i: int) -> dict[str, np.ndarray]:
    """The arrays of a piece from rows that begin with (block, c, root, n, sig)."""
    block, c, root, n = (np.array([r[k] for r in held], np.int64) for k in range(4))
    sig = np.frombuffer(b"".join(r[4] for r in held), np.uint32).reshape(-1, HASHES)
    return {"c": c, "root": root, "n": n, "sig": sig, "own": bands(sig), "first": block == i}


def joining_links(shared: DataFrame, of: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components ``of``, as many as join them, from all pairs of classes that share a bucket.

    Two passes over pieces, each of two blocks of a bucket. The first compares signatures and returns the classes that have a
    candidate at all, never the pairs; the second brings their full sets, finds the candidates again and verifies them, the most
    alike first, as long as their components are not joined. Its pieces are cut to HELD shingles a side.
    """
    at = cut_lineage(split_join(shared.select("band", "c"), of.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c")))
    several = at.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high")
    several = cut_lineage(several.select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    at = split_join(at, several, "band").withColumn("block", F.pmod(F.xxhash64("c", "band"), F.col("blocks")).cast("int"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "root")
    at = split_join(at, classes.select("c", "n", "sig"), "c").select("band", "i", "j", "block", "c", "root", "n", "sig")
    limits = least_matches(percent)

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (band, i, j), held in pieces_of(rows):
            piece = of_piece(held, i)
            n, first = piece["n"], piece["first"]
            # cuts of a side hold HELD shingles at most, or one class
            cut = np.zeros(len(n), np.int64)
            for side in (np.flatnonzero(first), np.flatnonzero(~first)):
                cut[side] = np.cumsum(n[side]) // HELD
            met: set[tuple[int, int, int]] = set()
            for a, b, _ in open_pairs(piece, band, i == j, limits, percent):
                pair = np.stack([cut[a], cut[b]])
                if i == j:
                    pair.sort(axis=0)
                for ends in (a, b):
                    met.update(zip(pair[0].tolist(), pair[1].tolist(), ends.tolist()))
            for k, m, at_ in sorted(met):
                yield band, i, j, k, m, int(cut[at_]) if i == j else (k if first[at_] else -1 - m), *held[at_][1:4]

    found = map_batches(at.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j"), "band long, i int, j int, k int, m int, block int, c long, root long, n long", compare)
    sets = split_join(cut_lineage(found), classes.select("c", "sig", "shingles"), "c").select("band", "i", "j", "k", "m", "block", "c", "root", "n", "sig", "shingles")

    def verify(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (band, i, j, k, m), held in pieces_of(rows, 5):
            piece = of_piece(held, k)
            joined: dict[int, int] = {}

            def top(c: int) -> int:
                while joined.setdefault(c, c) != c:
                    joined[c] = c = joined.setdefault(joined[c], joined[c])
                return c

            root, c = piece["root"].tolist(), piece["c"].tolist()
            for a, b, matches in open_pairs(piece, band, i == j and k == m, limits, percent):
                order = np.argsort(-matches, kind="stable")
                for x, y in zip(a[order].tolist(), b[order].tolist()):
                    p, q = top(root[x]), top(root[y])
                    if p != q and alike(np.frombuffer(held[x][5], np.uint64), np.frombuffer(held[y][5], np.uint64), percent):
                        joined[p] = q
                        yield c[x], c[y]

    return map_batches(sets.repartition("band", "i", "j", "k", "m").sortWithinPartitions("band", "i", "j", "k", "m"), "a long, b long", verify)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns; of rows equal in id and text one."""
    kept = near_duplicates(docs, id_col, text_col, percent).where("kept").select(text_key(id_col).alias("owner"), "hash").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(id_col).alias("owner"), F.xxhash64(text_col).alias("hash"))
    return packed.join(kept, ["owner", "hash"]).dropDuplicates(["owner", "hash"]).select("row.*")
