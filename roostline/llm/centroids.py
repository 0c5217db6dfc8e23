"""Centroid clustering in exact integers; an n-simplex projection tells which centroids need not be compared.

The distances of a vector to n pivots fix the apex of a simplex over the pivots: n coordinates, computed and written
once. The Euclidean distance of two apexes is a lower bound of the distance of the two vectors, and with one of
them mirrored at the base an upper one. A centroid whose lower bound is above the least upper bound, or above the
distance of the centroid that looks nearest, is passed over; the others are compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.llm.common import table
from roostline.session import staged

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
# Integers beyond this count as this: squared distances of 64 components then fit a long.
LARGEST = 1 << 27
PIVOTS = 16
# A further pivot has to rise above the others by this part of the largest distance, or the projection loses digits.
RISE = 0.05
# What rounding may take from a bound, as a part of the squared lengths that it comes from.
SLACK = 1e-9
CHUNK = 1024


def usable(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has all its components and each is a finite number; false for null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(embedding) == dimensions) & F.forall(embedding.cast("array<double>"), finite), F.lit(False))


def integers(values: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of floor(256 * x)."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(-1, dimensions)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to those of ``b`` beside them."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Simplex:
    """Pivots and their base simplex: the first at the origin, each further one with one coordinate more."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS) -> None:
        self.pivots, self.base = candidates[:1], np.zeros((1, 0))
        widest = float(max((squared(candidates, c).max() for c in candidates), default=0)) ** 0.5
        while len(self.pivots) < most:
            # The candidate that rises highest above the pivots so far.
            apexes = self.apexes(candidates)
            best = int(np.argmax(apexes[:, -1]))
            if apexes[best, -1] <= RISE * widest:
                break
            self.base = np.vstack([np.hstack([self.base, np.zeros((len(self.base), 1))]), apexes[best]])
            self.pivots = np.vstack([self.pivots, candidates[best]])

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates of each vector over the base; the last is its height, which is not negative."""
        d = np.stack([squared(vectors, p) for p in self.pivots], axis=1).astype(np.float64)
        base = self.base[1:]
        right = ((base**2).sum(axis=1) + d[:, :1] - d[:, 1:]) / 2
        flat = np.linalg.solve(base, right.T).T if len(base) else np.zeros((len(d), 0))
        height = np.sqrt(np.maximum(d[:, 0] - (flat**2).sum(axis=1), 0))
        return np.column_stack([flat, height])


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller of equals), squared distance, and how many exact comparisons that took."""
    size_a, size_c = (apexes**2).sum(axis=1), (peaks**2).sum(axis=1)
    lower = size_a[:, None] + size_c - 2 * (apexes @ peaks.T)
    upper = lower + 4 * np.outer(apexes[:, -1], peaks[:, -1])
    slack = SLACK * (size_a + size_c.max()) + 1
    look = lower.argmin(axis=1)
    known = squared(vectors, centroids[look])
    limit = np.minimum(upper.min(axis=1), known.astype(np.float64)) + slack
    near = lower - slack[:, None] <= limit[:, None]
    near[np.arange(len(near)), look] = True
    row, which = np.nonzero(near)
    exact = squared(vectors[row], centroids[which])
    edge = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(exact, edge)
    first = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[edge, len(row)])))
    first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
    return which[first], least, len(row)


def _project(simplex: Simplex, dimensions: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            vectors = integers(values, dimensions)
            apexes = simplex.apexes(vectors)
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (vectors.astype("<i4"), apexes.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], names=["vec_id", "v", "apex"])

    return project


def _unpacked(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _assigned(centroids: np.ndarray, peaks: np.ndarray, batch: pa.RecordBatch):
    """Pieces of a batch of projected vectors: rows from, to, vectors, cluster, distance."""
    vectors, apexes = _unpacked(batch.column(1), "<i4", batch.num_rows).astype(np.int64), _unpacked(batch.column(2), "<f8", batch.num_rows)
    for low in range(0, batch.num_rows, CHUNK):
        some = slice(low, low + CHUNK)
        cluster, distance, _ = nearest(vectors[some], apexes[some], centroids, peaks)
        yield low, min(low + CHUNK, batch.num_rows), vectors[some], cluster, distance


def _sums(centroids: np.ndarray, peaks: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per cluster and task: how many vectors, and their componentwise sum."""
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for *_, vectors, cluster, _ in _assigned(centroids, peaks, batch):
                order = np.argsort(cluster, kind="stable")
                edge = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                total[cluster[order][edge]] += np.add.reduceat(vectors[order], edge, axis=0)
                count += np.bincount(cluster, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    return add


def _distances(centroids: np.ndarray, peaks: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, cluster, distance in _assigned(centroids, peaks, batch):
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return assign


def _recentred(projected: DataFrame, centroids: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors becomes the floor of their mean. The driver gets one row per centroid."""
    dimensions = centroids.shape[1]
    parts = projected.mapInArrow(_sums(centroids, peaks), "cluster INT, n BIGINT, s ARRAY<BIGINT>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    moved = parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), *[exact(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(dimensions)])
    out = centroids.copy()
    for r in moved.collect():
        out[r.cluster] = [int(r[f"s{i}"]) // int(r.n) for i in range(dimensions)]
    return out


def clusters(vectors: DataFrame, start: Column, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of each usable row of ``vectors`` (vec_id, embedding), and the final centroids.

    Components are the integers floor(256 * x). The k rows with the smallest ``start`` (ties: by their components; null
    last) are the first centroids, in that order. In each round all vectors go to the nearest centroid
    (ties: the smaller number), and each centroid with vectors moves to the componentwise floor of their mean.
    Rows whose vector is null, of another length, or has a null or non-finite component are left out. Null ids
    and repeated rows are rows like any other; fewer rows than k give fewer clusters, none give an empty table. The
    driver holds the centroids only; a task holds one batch of vectors.
    """
    kept = vectors.where(usable(F.col("embedding"), dimensions)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), start.alias("start")
    )
    first = kept.orderBy(F.col("start").asc_nulls_last(), "e").limit(k).collect()
    out = "vec_id BIGINT, cluster INT, distance BIGINT"
    if not first:
        return vectors.sparkSession.createDataFrame([], out), np.zeros((0, dimensions), np.int64)
    centroids = integers(np.array([r.e for r in first]), dimensions)
    simplex = Simplex(centroids)
    project = _project(simplex, dimensions)
    projected = staged(kept.select("vec_id", "e").mapInArrow(project, "vec_id BIGINT, v BINARY, apex BINARY"), "apexes")
    for _ in range(rounds):
        centroids = _recentred(projected, centroids, simplex.apexes(centroids))
    return projected.mapInArrow(_distances(centroids, simplex.apexes(centroids)), out), centroids


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found, centroids = clusters(given, F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256))
    found = staged(found, "clusters")
    per = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row per cluster that has vectors, as literals.
    facts: Callable[[list], Column] = lambda values: F.get(F.array(*map(F.lit, values or [None])), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", "distance",
        facts([per.get(i, 0) for i in range(len(digests))]).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(per.values())).cast("bigint").alias("inertia"),
        facts(digests).cast("string").alias("centroid_sha256"),
    )


def _sql() -> str:
    """The same in SQL: all distances, round by round."""
    distance = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, c.v)])::BIGINT"
    parts = [
        f"kept AS (SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings "
        f"WHERE len(embedding) = {DIMENSIONS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {DIMENSIONS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CLUSTERS}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS (SELECT rid, vec_id, v, c, d FROM (SELECT k.rid, k.vec_id, k.v, c.c, {distance} AS d FROM kept k, c{i} c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"
        )
        if i < ROUNDS:
            parts.append(
                f"c{i + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(s ORDER BY i) AS v FROM (SELECT c, i, floor(sum(x) / count(*))::BIGINT AS s "
                f"FROM (SELECT c, unnest(v) AS x, unnest(generate_series(1, {DIMENSIONS})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) m USING (c))"
            )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, "
        f"sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} f USING (c)"
    )


OP11_SQL = _sql()
