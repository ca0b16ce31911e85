"""Centroid clustering against a plain computation."""

import hashlib

import numpy as np

from strandspark.llm import centroids


def _plain(rows, k, rounds, width):
    """(id, cluster, distance) of every kept row, the inertia, and the centroids."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept)
    centre = [v for _, v in order[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min((away(v, c), j) for j, c in enumerate(centre)) for _, v in kept]
        if r < rounds:
            for j in range(len(centre)):
                if mine := [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]:
                    centre[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((i, j, d) for (i, _), (d, j) in zip(kept, at, strict=True)), sum(d for d, _ in at), centre


def _found(spark, rows, **options):
    data = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<double>, cluster string")
    return centroids.clustered(data, **options).collect()


def test_equals_the_plain_computation(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (9, 12))
    rows = [(i, (middle[i % 9] + rng.normal(0, 0.2, 12)).tolist()) for i in range(400)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, rows[0][1][:-1]), (1003, [None, *rows[0][1][1:]]), (1004, [float("nan")] * 12), (1005, [float("inf")] * 12)]
    found = _found(spark, rows, k=15, rounds=4, width=12)
    plain, inertia, centre = _plain(rows, 15, 4, 12)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == plain
    assert {r.inertia for r in found} == {inertia}
    sums = {j: sum(d for _, c, d in plain if c == j) for j in range(15)}
    assert all(r.cluster_inertia == sums[r.cluster] and r.centroid_sha256 == hashlib.sha256(",".join(map(str, centre[r.cluster])).encode()).hexdigest() for r in found)


def test_clusters_prune_exact_distances(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (10, 32)) * rng.choice([0.1, 3], (10, 32))
    data = spark.createDataFrame([(i, (middle[i % 10] + rng.normal(0, 0.05, 32)).tolist()) for i in range(600)], "id long, vector array<double>")
    assert centroids.exact_share(data, k=10, rounds=3, width=32) < 0.4


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(5)
    for scale in (3, 300, 2**20, 2**27):
        x, c = rng.integers(-scale, scale + 1, (200, 64)), rng.integers(-scale, scale + 1, (40, 64))
        c[:10] = x[:10]
        bound = centroids.lower_bounds(centroids.segment_norms(x).astype("<f4"), centroids.segment_norms(c))
        exact = np.stack([centroids.exact_distances(x, v) for v in c], 1)
        assert (bound <= exact).all()
        cluster, best, _ = centroids.nearest(x, centroids.segment_norms(x).astype("<f4"), c)
        assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()


def test_few_equal_empty_and_extreme_vectors(spark):
    assert _found(spark, [], width=2) == []
    assert _found(spark, [(1, None)], width=2) == []
    equal = _found(spark, [(i, [0.5, -0.5]) for i in (1, 1, 2, None)], k=3, width=2)
    assert len(equal) == 4 and {(r.cluster, r.distance, r.inertia) for r in equal} == {(0, 0, 0)}
    far = _found(spark, [(1, [1e300, -1e300]), (2, [-1e300, 1e300]), (3, [0.0, 0.0])], k=2, rounds=2, width=2)
    assert len(far) == 3 and all(0 <= r.distance <= r.inertia <= 2**63 - 1 for r in far)
