"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its NEAREST reference points in order of nearness. The inverted lists are kept per combination of
SHARED pivots, so that meeting in a list already means that many shared pivots; candidates of a list are verified by cosine in
double precision, and a pair is counted in the list of its first shared combination only. Long lists are cut into blocks and
every two blocks of a list are one small piece of work, so a list of any length is spread over tasks; links leave a piece as
counts and as one row per vector that names its component there, never as pairs.

The pivots are chosen from a sample of at most SAMPLE distinct vectors, the only thing taken to the driver, so that no two are
alike (a group of near-duplicates must not hold several, whose order it would shuffle); fixed random points fill up their
number. Every vector is indexed. Recall against brute force on the test tables is 1.0 at the given numbers.

Defined cases: vectors that are null, empty or zero, hold null or a component that is not finite, or have no label, link with
nothing; so do vectors of different length; equal vectors of a label are one class whose members link with each other; null
ids are no candidates for a component's id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .graph import components, split_join
from .rows import cut_lineage, least_hashed

COSINE = 0.98
PIVOTS, NEAREST, SHARED = 256, 7, 3
SAMPLE = 1024
ALIKE = 0.6  # cosine that two pivots stay below
BLOCK = 256
ROWS, PAIRS = 1024, 100_000  # vectors and pairs that are worked on at once


def unit(values: list) -> np.ndarray:
    v = np.array(values, np.float64)
    v /= np.abs(v).max()
    return v / np.sqrt(v @ v)


def reference_points(sample: list[list], width: int) -> np.ndarray:
    """PIVOTS unit vectors: from the sample, in order, those unlike all chosen before; then fixed random ones."""
    points = np.random.default_rng(width).standard_normal((PIVOTS, width))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    n = 0
    for values in sample:
        v = unit(values)
        if n < PIVOTS and (points[:n] @ v < ALIKE).all():
            points[n] = v
            n += 1
    return points


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as the rows of one matrix, scaled to length 1 and filled up with zeros, and their lengths before."""
    width, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    v = np.zeros((len(width), width.max(initial=0)))
    if v.size == flat.size:
        v[:] = flat.reshape(v.shape)
    else:
        v[np.arange(v.shape[1]) < width[:, None]] = flat
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True)), width


def nearest(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Numbers of the NEAREST points of each row, ascending; of equally near points the first."""
    s = v @ points.T
    best = s >= np.partition(s, PIVOTS - NEAREST, axis=1)[:, PIVOTS - NEAREST, None]
    for k in np.nonzero(best.sum(axis=1) > NEAREST)[0]:
        best[k] = False
        best[k, np.argsort(-s[k], kind="stable")[:NEAREST]] = True
    return np.nonzero(best)[1].reshape(-1, NEAREST)


def described(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The columns of ``classes`` (node, n, label as a number, v), near (the nearest pivots, ascending) and lists (for every pivot
    combination its list's key and its last pivot)."""
    sets = np.array(list(combinations(range(NEAREST), SHARED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(5).integers(1, 1 << 62, SHARED + 1) * 2 + 1
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                v, width = matrix(part["v"])
                near = np.empty((len(v), NEAREST), np.int64)
                for w in np.unique(width):
                    if w not in pivots:  # a length the sample did not meet
                        pivots[w] = reference_points([], w)
                    of = width == w
                    near[of] = nearest(v[of, :w], pivots[w])
                combined = near[:, sets]
                keys = (combined * factors[:SHARED]).sum(axis=2) * factors[-1] + part["label"].to_numpy()[:, None]
                each = pa.StructArray.from_arrays([pa.array(keys.ravel()), pa.array(combined[:, :, -1].ravel().astype(np.int16))], ["list", "last"])
                at = lambda n: pa.array(np.arange(len(v) + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at(NEAREST), pa.array(near.ravel().astype(np.int16))),
                                                  pa.ListArray.from_arrays(at(len(sets)), each)], [*part.schema.names, "near", "lists"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{kept}, near array<smallint>, lists array<struct<list:bigint,last:smallint>>")


def links_of(rows: pa.Table) -> pa.RecordBatch:
    """(node, other, links) rows of whole pieces in order: links are the members of linked classes, other a node of the row's
    component in its piece. Pieces of one size are compared at once, one matrix product each."""
    piece, block, node, size, label, last = (np.stack([rows[k].to_numpy() for k in ("list", "i", "j")]), *(rows[k].to_numpy() for k in ("block", "node", "n", "label", "last")))
    v, width = matrix(rows["v"].combine_chunks())
    near = rows["near"].combine_chunks().flatten().to_numpy().reshape(-1, NEAREST)
    starts = np.concatenate([[0], 1 + np.nonzero((piece[:, 1:] != piece[:, :-1]).any(axis=0))[0]])
    lengths = np.diff(starts, append=len(node))
    pairs = []
    for length in np.unique(lengths[lengths > 1]):
        of = starts[lengths == length]
        together = max(1, ROWS // length)  # pieces at once
        for k in range(0, len(of), together):
            members = of[k:k + together, None] + np.arange(length)
            x = v[members]
            g, a, b = np.nonzero(np.triu(x @ x.transpose(0, 2, 1) >= COSINE, 1))
            pairs.append((members[g, a], members[g, b]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    # pairs inside a block belong to the block's own piece
    met = (label[a] == label[b]) & (width[a] == width[b]) & ((piece[1, a] == piece[2, a]) | (block[a] != block[b]))
    a, b = a[met], b[met]
    links, least = np.zeros(len(node), np.int64), np.arange(len(node))
    has = np.zeros((len(node), PIVOTS), bool)
    has[least[:, None], near] = True
    for k in range(0, len(a), PAIRS):
        one, two = a[k:k + PAIRS], b[k:k + PAIRS]
        # the list's own pivots are shared by all its rows; no other shared pivot may come before its last one
        before = has[two[:, None], near[one]] & (near[one] < last[one][:, None])
        counted = before.sum(axis=1) == SHARED - 1
        np.add.at(links, one[counted], size[two[counted]])
        np.add.at(links, two[counted], size[one[counted]])
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    while True:
        lower = least.copy()
        np.minimum.at(lower, a, least[b])
        if (lower == least).all():
            break
        least = lower
    k = np.unique(a)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (node[k], node[least[k]], links[k])], ["node", "other", "links"])


def piece_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``links_of`` whole pieces: rows of the last piece of a batch wait for the next batch."""
    held = None
    for batch in batches:
        held = pa.concat_tables([held, pa.table(batch)]) if held else pa.table(batch)
        piece = np.stack([held[k].to_numpy() for k in ("list", "i", "j")])
        begun = np.nonzero((piece[:, 1:] != piece[:, :-1]).any(axis=0))[0]
        if len(begun):
            yield links_of(held.slice(0, begun[-1] + 1))
            held = held.slice(begun[-1] + 1)
    if held:
        yield links_of(held)


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    vector = F.col(vector_col)
    most, least = F.array_max(vector), F.array_min(vector)  # NaN is the greatest of all
    sound = (F.col(label_col).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()) & (most < F.lit(float("inf"))) & (least > F.lit(float("-inf")))
             & ((most > 0) | (least < 0)))
    kind = "array<float>" if isinstance(table.schema[vector_col].dataType, ArrayType) and isinstance(table.schema[vector_col].dataType.elementType, FloatType) else "array<double>"
    rows = table.select(F.col(id_col).alias("id"), F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(label_col, vector_col)).alias("node"), F.col(label_col).alias("label"), vector.cast(kind).alias("v"))
    classes = cut_lineage(rows.where("node is not null").groupBy("node", "label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")))

    sample = least_hashed(classes.select("v", "node"), ["node"], SAMPLE).orderBy("node").collect()
    pivots: dict[int, list] = {}
    for r in sample:
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    numbered = classes.select("node", "n", F.xxhash64("label", F.size("v")).alias("label"), "v")
    index = cut_lineage(described(numbered, {width: reference_points(p, width) for width, p in pivots.items()}))
    postings = index.select("node", F.inline("lists"))
    lists = postings.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    lists = cut_lineage(lists.select("list", F.ceil(F.col("length") / BLOCK).cast("int").alias("blocks")))
    listed = split_join(postings, lists.hint("shuffle_hash"), "list").withColumn("block", F.pmod(F.xxhash64("node", "list"), F.col("blocks")).cast("int"))
    pieces = listed.select("list", "node", "last", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "last", "block")
    full = split_join(pieces, index.select("node", "n", "label", "near", "v"), "node")
    found = full.select("list", "i", "j", "block", "node", "n", "label", "last", "near", "v").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    found = cut_lineage(found.mapInArrow(piece_links, "node bigint, other bigint, links bigint"))
    of = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    figures = split_join(split_join(classes.select("node", "id", "n"), counts, "node", "left"), of, "node", "left").select(
        "node", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    figures = cut_lineage(figures)
    named = split_join(figures, figures.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "n_links", "component_id")
    out = split_join(rows.select("id", "node"), named, "node", "left")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
