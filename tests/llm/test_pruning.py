"""What the dual-tree search prunes, and that hot ids and groups are split."""

import numpy as np
import pytest

from strandspark.llm import cover_tree


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v) for i, v in zip(ids if ids is not None else range(len(x)), x.tolist(), strict=True)], "id long, vector array<double>")


def best(x, ids, asked, k):
    e = np.floor(256 * x)
    out = set()
    for q in asked:
        rank = sorted((-int(e[q] @ e[i]), int(ids[i])) for i in range(len(x)) if ids[i] != ids[q])[:k]
        out |= {(int(ids[q]), n + 1, j, -s) for n, (s, j) in enumerate(rank)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_clusters_are_pruned(spark, monkeypatch, small):
    if small:  # many blocks, groups and lots
        for name, n in (("BLOCK", 150), ("GROUP", 8), ("LOT", 2), ("LEAF", 16)):
            monkeypatch.setattr(cover_tree, name, n)
    rng = np.random.default_rng(4)
    x = 4 * rng.normal(size=(12, 8))[rng.integers(0, 12, 1500)] + 0.02 * rng.normal(size=(1500, 8))
    data = frame(spark, x)
    queries = data.where("id % 50 = 0")
    got = {tuple(r) for r in cover_tree.top_k(data, queries, 4).collect()}
    assert got == best(x, np.arange(1500), range(0, 1500, 50), 4)
    if small:
        assert cover_tree.scored_pairs(data, queries, 4) < 0.6 * 30 * 1500


def test_an_id_with_a_third_of_the_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 100)
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(900, 5)), np.arange(900)
    ids[:300] = 7
    data = frame(spark, x, ids)
    got = {tuple(r) for r in cover_tree.top_k(data, data.where("id % 100 = 1"), 3).collect()}
    assert got == best(x, ids, [i for i in range(300, 900) if i % 100 == 1], 3)


def test_packed_rows():
    for most in (3, 300, 70_000, 1e12):
        x = np.floor(np.random.default_rng(1).normal(size=(9, 4)) * most)
        assert (cover_tree.unpacked(cover_tree.packed(x)) == x).all()
    assert cover_tree.unpacked([cover_tree.packed(np.ones((1, 2)))[0], cover_tree.packed(np.ones((1, 3)))[0]]).tolist() == [[1, 1, 0], [1, 1, 1]]
