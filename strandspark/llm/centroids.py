"""Integer k-means whose exact distances are taken only where a bound by segment norms allows them.

Every vector is kept as integers, together with its compressed form: the Euclidean
norms of its segments. By Cauchy and Schwarz, segment by segment, two vectors are at
least as far apart as their compressed forms, so |x - c|^2 >= sum over segments of
(|x_s| - |c_s|)^2. These bounds of all centroids are one small matrix product. A first
exact distance, to the centroid of the least bound, is the limit: a centroid
whose bound lies above the limit is screened out, and only the others receive exact integer
distances, nearest bounds first, which lowers the limit further.

The compact table (integers and norms) is written once. A round is a pass over it without a
shuffle of vectors: tasks send one row of sums for each centroid that they have met, and
the centroids (at most ``k``) are on the driver between rounds.

Edge cases: vectors that are null, have another number of components than ``width``,
or hold a null or non-finite component take no part; with fewer kept vectors than
``k`` each is a centroid; equal vectors may be several centroids, of which the smallest
number takes all; rows with a null id are clustered but start as centroids only after all
others; of rows that share an id, those whose bytes are smaller start first; integers
are clipped to 2^27 either way, so that a squared distance fits a long, and sums of
distances are clipped to the range of a long; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .cover_tree import valid

SCALE, MOST = 256, 2**27
#: Components of a segment, and vectors whose bounds are held at a time.
SEGMENT, LOT = 4, 4_096
#: Norms are kept as 32-bit floats: a bound is lowered by this share of the squared norms.
_SLACK = 1e-6
_LONGEST = 2**63 - 1
_COMPACT = "id long, vector binary, norms binary"


def whole_numbers(x: Column) -> Column:
    """floor(256 x) of each component, within the clip, as 32-bit integers."""
    return F.transform(x, lambda v: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(v.cast("double") * SCALE).cast("double"))).cast("int"))


def segment_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the runs of SEGMENT components; the last run may be shorter."""
    starts = np.arange(0, x.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1)) if x.shape[1] else np.zeros((len(x), 0))


def lower_bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """What no squared distance of a vector (row) and a centroid (column) falls below."""
    a, b = norms.astype(np.float64), centroid_norms
    sizes = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :]
    return np.maximum(0, sizes - 2 * (a @ b.T) - _SLACK * sizes)


def exact_distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances to one centroid, as integers; in floats only where these are exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroid).max(initial=0)) < 2**22 and x.shape[1] <= 256:
        away = x.astype(np.float64) - centroid
        return np.einsum("ij,ij->i", away, away).astype(np.int64)
    away = x.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", away, away)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (the smallest number on ties), the squared distance, and how many exact distances were taken."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    bound = lower_bounds(norms, segment_norms(centroids))
    first = bound.argmin(1)
    best, cluster = np.empty(len(x), np.int64), first.copy()
    for c in np.unique(first):
        rows = np.flatnonzero(first == c)
        best[rows] = exact_distances(x[rows], centroids[c])
    taken = len(x)
    for c in np.argsort(bound.mean(0), kind="stable"):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if not len(rows):
            continue
        away = exact_distances(x[rows], centroids[c])
        taken += len(rows)
        closer = (away < best[rows]) | ((away == best[rows]) & (c < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = away[closer], c
    return cluster, best, taken


def compact(data: DataFrame, width: int) -> DataFrame:
    """id, vector (little-endian 32-bit integers) and norms (32-bit floats) of the kept rows of ``data`` (id, vector)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            x = np.asarray(lists.flatten(), "<i4").reshape(len(lists), width)
            rows = lambda m: pa.array([row.tobytes() for row in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), rows(x), rows(segment_norms(x).astype("<f4"))], ["id", "vector", "norms"])

    kept = data.where(valid(F.col("vector")) & (F.size("vector") == width))
    return kept.select(F.col("id").cast("long").alias("id"), whole_numbers(F.col("vector")).alias("vector")).mapInArrow(pack, _COMPACT)


def first_centroids(points: DataFrame, k: int, salt: str, width: int) -> np.ndarray:
    """The k vectors of smallest SHA-256 of ``salt:id``, as rows in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    found = points.select(key.alias("key"), "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(k).toPandas()  # k rows
    return np.frombuffer(b"".join(found.vector), "<i4").reshape(len(found), width).astype(np.int64)


def _lots(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, LOT):
            part = batch.slice(k, LOT)
            x = np.frombuffer(b"".join(part.column("vector").to_pylist()), "<i4").reshape(part.num_rows, width)
            yield part, x, np.frombuffer(b"".join(part.column("norms").to_pylist()), "<f4").reshape(part.num_rows, -1)


def _summed(centroids: np.ndarray):
    """A row for each centroid that a task's vectors are nearest to: their number, and the sums of their components."""
    k, width = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, taken = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0
        rows = 0

        def out() -> pa.RecordBatch:
            met = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), *(pa.array(c) for c in sums[met].T.copy()), pa.array([taken] + [0] * (len(met) - 1), pa.int64())], ["cluster", "n", *(f"s{i}" for i in range(width)), "taken"])

        for _, x, norms in _lots(batches, width):
            if rows > 2**34:  # sums of clipped components stay within a long
                yield out()
                n[:], sums[:], taken, rows = 0, 0, 0, 0
            cluster, _, exact = nearest(x, norms, centroids)
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(0, dtype=np.int64)
            taken, rows = taken + exact, rows + len(x)
        if rows:
            yield out()

    return summed


def moved(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and how many exact distances the round took; centroids without vectors stay."""
    k, width = centroids.shape
    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(["cluster int", "n long", *(f"{c} long" for c in names), "taken long"])
    rows = points.mapInArrow(_summed(centroids), schema).groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in ("n", *names, "taken")]).collect()  # a row a centroid
    out, taken = centroids.copy(), 0
    for row in rows:
        out[row.cluster] = [int(row[c]) // int(row.n) for c in names]
        taken += int(row.taken)
    return out, taken


def _assigned(centroids: np.ndarray):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, norms in _lots(batches, centroids.shape[1]):
            cluster, distance, _ = nearest(x, norms, centroids)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return assigned


def _described(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, cluster_inertia, inertia and centroid_sha256: a row a centroid."""
    sums = {row.cluster: int(row.d) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
    total = min(_LONGEST, sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, min(_LONGEST, sums.get(i, 0)), total, digest(c)) for i, c in enumerate(centroids)]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def clustered(data: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", width: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of ``data`` (id, vector)."""
    spark = data.sparkSession
    points = written(compact(data, width), "compact-vectors")
    centroids = first_centroids(points, k, salt, width)
    if len(centroids):
        for _ in range(rounds):
            centroids, _ = moved(points, centroids)
    assigned = written(points.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    about = _described(spark, assigned, centroids)  # k rows
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def exact_share(data: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", width: int = 64) -> float:
    """Of all distances of vectors and centroids in ``rounds`` rounds, the share that was taken exactly."""
    points = written(compact(data, width), "compact-vectors")
    centroids, total = first_centroids(points, k, salt, width), 0
    for _ in range(rounds):
        centroids, taken = moved(points, centroids)
        total += taken
    return total / max(1, points.count() * len(centroids) * rounds)
