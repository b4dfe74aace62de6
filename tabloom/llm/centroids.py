"""Centroid clustering of integer vectors, filtered in a PCA rotation and decided in integers.

Components are scaled and floored to integers; mean and covariance of all vectors are sums over Spark tasks, and the
covariance's axes rotate the space. A vector is stored once with its LEADING rotated coordinates and the norm of the rest. For
a centroid treated alike, the squared distance of the leading coordinates plus the squared difference of the rest norms is never
above the squared distance, so a centroid whose bound lies above the distance to the most promising one is out; those that
survive are compared in 64-bit integers. The rotation only filters: rounding, covered by SLACK, cannot change a result.

A round is one pass over the stored vectors whose tasks return one sum per cluster and component; the driver holds centroids,
sums and the covariance only, whose sizes are k * width and width squared. Nothing is sampled.

Defined cases: vectors of another width, that are null, or that hold null or a component that is not finite are left out, as
are those with a component whose scaled value does not fit a 64-bit distance (above 2**27 for 64 components); equal rows are
vectors of their own; rows with a null id are clustered but never start a centroid; ties in the starting order (repeated ids)
go by the vector; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import cut_lineage, sql_type

LEADING = 12
SLACK = 1e-9  # of the squared norms, far above the rounding of doubles
CHUNK = 4096  # vectors compared at once


def scaled_vectors(table: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """id, q (array of long) of the vectors that are kept."""
    limit = math.isqrt((1 << 61) // width)
    q = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale))
    x = F.col(vector_col)
    sound = (F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale <= float(limit)))
    return table.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), q.alias("q"))


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """Fixed-width values in rows, from a column of lists or bytes."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def moments(vectors: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of the vectors: a task returns its sums, one row per cell, and Spark adds them up."""
    upper = np.triu_indices(width + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            v = np.column_stack([np.ones(batch.num_rows), matrix(batch.column(0), width)])
            total += v.T @ v
        if total[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*upper, total[upper])], ["i", "j", "s"])

    cells = vectors.select("q").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((width + 1, width + 1))
    for r in cells:
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["s"]
    n = int(total[0, 0])
    mean = total[0, 1:] / max(n, 1)
    return n, mean, total[1:, 1:] / max(n, 1) - np.outer(mean, mean)


class Rotation:
    """Leading coordinates along the covariance's axes, and the norm of the rest."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, leading: int) -> None:
        axes = np.linalg.eigh(covariance)[1][:, ::-1]
        self.mean, self.axes = mean, np.ascontiguousarray(axes[:, :leading])

    def __call__(self, q: np.ndarray) -> np.ndarray:
        v = q - self.mean
        lead = v @ self.axes
        rest = v - lead @ self.axes.T
        return np.column_stack([lead, np.sqrt((rest * rest).sum(axis=1))])


def nearest(q: np.ndarray, described: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every vector. ``described`` and ``centres`` are vectors and centroids as rotated; a row's
    rest norm lies beside its coordinates, so that one squared distance of these rows is the lower bound."""
    norms, own = (centres * centres).sum(axis=1), (described * described).sum(axis=1)
    bound = own[:, None] + norms - 2 * (described @ centres.T)
    slack = SLACK * (own[:, None] + norms + 1)
    best = bound.argmin(axis=1)
    off = q - centroids[best]
    distance = (off * off).sum(axis=1)
    bound -= slack
    bound[np.arange(len(q)), best] = np.inf
    row, centre = np.nonzero(bound <= distance[:, None])
    for start in range(0, len(row), CHUNK):
        r, c = row[start:start + CHUNK], centre[start:start + CHUNK]
        off = q[r] - centroids[c]
        d = (off * off).sum(axis=1)
        order = np.lexsort((c, d, r))  # of a vector's survivors the nearest, then the smallest number
        r, c, d = r[order], c[order], d[order]
        first = np.concatenate([[True], r[1:] != r[:-1]])
        r, c, d = r[first], c[first], d[first]
        better = (d < distance[r]) | ((d == distance[r]) & (c < best[r]))
        best[r[better]], distance[r[better]] = c[better], d[better]
    return best, distance


def assigned(stored: DataFrame, centroids: np.ndarray, rotation: Rotation, id_type: str) -> DataFrame:
    width, places = centroids.shape[1], rotation.axes.shape[1] + 1
    centres = rotation(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                best, distance = nearest(matrix(part.column(1), width), matrix(part.column(2), places, np.float64), centroids, centres)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return stored.mapInArrow(run, f"id {id_type}, cluster int, distance long")


def moved(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Centroids after one round: exact sums per cluster and component, floored quotients; empty clusters stay."""
    (k, width), places = centroids.shape, rotation.axes.shape[1] + 1
    centres = rotation(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                q = matrix(part.column(0), width)
                best, _ = nearest(q, matrix(part.column(1), places, np.float64), centroids, centres)
                order = np.argsort(best, kind="stable")
                found, at = np.unique(best[order], return_index=True)
                total[found, 1:] += np.add.reduceat(q[order], at, axis=0)
                total[found, 0] += np.diff(np.append(at, len(q)))
        cluster, place = np.nonzero(total[:, :1] + np.zeros_like(total))
        if len(cluster):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster, place, total[cluster, place])], ["cluster", "place", "s"])

    sums = stored.select("q", "described").mapInArrow(run, "cluster long, place long, s long")
    cells = sums.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = {(r["cluster"], r["place"]): int(r["s"]) for r in cells}
    out = centroids.copy()
    for cluster in {c for c, _ in total}:
        out[cluster] = [total[cluster, 1 + d] // total[cluster, 0] for d in range(width)]
    return out


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, k: int = 40, rounds: int = 5, scale: int = 256,
            salt: str = "2", leading: int = LEADING) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid (its integers) for every vector that is kept.

    Centroids start as the ``k`` vectors with the least sha256 of ``salt:id``.
    """
    spark, id_type = table.sparkSession, sql_type(table, id_col)
    vectors = cut_lineage(scaled_vectors(table, id_col, vector_col, width, scale))
    started = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = vectors.where("id is not null").orderBy(started, "q").limit(k).select("q").collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, width)
    out = f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        return spark.createDataFrame([], out)
    _, mean, covariance = moments(vectors, width)
    rotation = Rotation(mean, covariance, min(leading, width))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in q]), pa.array([r.tobytes() for r in rotation(q)])], ["id", "q", "described"])

    stored = cut_lineage(vectors.mapInArrow(describe, f"id {id_type}, q binary, described binary"))
    for _ in range(rounds):
        centroids = moved(stored, centroids, rotation)
    found = cut_lineage(assigned(stored, centroids, rotation, id_type))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    figures = spark.createDataFrame([(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # one row per centroid, at most k
    return found.join(F.broadcast(figures), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
