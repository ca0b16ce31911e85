"""Small-world graphs against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.operators import graph, retrieval
from strandspark.operators.rounds import in_rounds, lots
from strandspark.plans import experiments


def _frame(spark, x, groups=None):
    return spark.createDataFrame([(i, int(groups[i]) if groups is not None else i % 3, v.tolist()) for i, v in enumerate(x)], "id long, grp long, vector array<double>")


def _clustered(n=3000, wide=24, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (40, wide))[rng.integers(0, 40, n)] + rng.normal(0, 0.15, (n, wide))


def _plain(x, q, k, allowed=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[q], 9)
    able = [i for i in range(len(x)) if i != q and (allowed is None or allowed[i])]
    return sorted(able, key=lambda i: (-s[i], i))[:k]


def test_recall_at_depth_100_and_share_of_scored_rows(spark):
    x = _clustered()
    data = _frame(spark, x)
    graphs = graph.build(data, part_rows=1000)
    assert graphs.agg(F.sum("n")).first()[0] == len(x) and graphs.count() == 3
    asked, recalls = data.where("id % 50 = 0"), []
    for depth in (10, 100):
        found = graph.searched(graphs, asked, 5, depth)
        best = {(r.query_id, r.id) for r in graph.best(found, 5).collect()}
        recalls.append(sum((q, i) in best for q in range(0, len(x), 50) for i in _plain(x, q, 5)) / 300)
        scored = found.agg(F.sum("scored")).first()[0] / (60 * len(x))
        assert 0 < scored < 0.45
    assert recalls[1] >= 0.95 and recalls[1] >= recalls[0]


def test_full_depth_is_exact_with_copies_and_scope(spark):
    x = _clustered(300)
    x[100:200] = x[7] * np.linspace(1, 9, 100)[:, None]  # equal directions
    groups = np.arange(300) % 4
    graphs = graph.build(_frame(spark, x, groups), part_rows=10_000)
    asked = _frame(spark, x, groups).where("id IN (7, 8, 150)")
    for scope in (None, (1, 2)):
        best = graph.best(graph.searched(graphs, asked, 12, 1000, scope), 12).collect()
        for q in (7, 8):
            found = sorted((r.rank, r.id) for r in best if r.query_id == q)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            s = np.round(u @ u[q], 9)
            plain = _plain(x, q, 12, None if scope is None else np.isin(groups, scope))
            assert np.allclose([s[i] for _, i in found], [s[i] for i in plain], atol=2e-9)
            assert scope is None or all(groups[i] in scope for _, i in found)


def test_level_is_connected_where_clusters_are_far_apart():
    rng = np.random.default_rng(2)
    x = graph._unit(np.concatenate([rng.normal(0, 1e-3, (150, 8)) + np.eye(8)[i] for i in range(6)]))
    links = graph.level_links(x)
    assert graph._pieces(links).max() == 0
    assert all(i in links[o] for i, own in enumerate(links) for o in own) and all(len(own) < 150 for own in links)


def test_odd_rows_take_no_part(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, None, [0.0, 1.0]), (4, 0, None), (5, 0, []), (6, 0, [0.0, 0.0]), (7, 0, [None, 1.0]), (8, 0, [float("inf"), 1.0]), (None, 0, [1.0, 1.0]), (9, 0, [1.0, 0.0, 0.0])]
    data = spark.createDataFrame(rows, "id long, grp long, vector array<double>")
    graphs = graph.build(data, part_rows=100)
    best = graph.best(graph.searched(graphs, data, 5, 100), 5).collect()
    assert {(r.query_id, r.id) for r in best} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert graph.build(data.limit(0)).count() == 0
    assert graph.searched(graphs, data.limit(0), 5, 100).count() == 0
    for depth in (0, 1001, True, 2.0):
        with pytest.raises(ValueError):
            graph.searched(graphs, data, 5, depth)


def test_registered_recall(spark):
    rows = {r.depth: r for r in experiments.q_index_recall(spark, "/root/testdata/sf0.01").collect()}
    assert sorted(rows) == [40, 100, 200, 400]
    assert rows[100].recall >= 0.9 and rows[400].recall >= rows[40].recall
    assert all(0 < r.scored_share <= 1 for r in rows.values()) and rows[40].scored_share < rows[400].scored_share


def test_rounds_hold_bounded_lots_and_lose_none(spark):
    data = spark.range(100).select("id", (F.col("id") % 7).alias("grp"), F.array(F.sin("id"), F.cos("id")).alias("vector"))
    asked = data.where("id < 30")
    sizes = [len(x) for x in lots(asked, "id", 8)]
    assert sum(sizes) == 30 and len(sizes) > 1

    def visit(lot):
        return lambda frames: ({"q": 0} and lot[["id"]] for _ in frames)

    assert in_rounds(data.coalesce(1), asked, "id", visit, "id long", 8).distinct().count() == 30


def test_batch_by_rounds_equals_plain_search(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (400, 3)).astype(float)  # many ties
    x[(x == 0).all(1)] = 1
    data = _frame(spark, x).repartition(5)
    found = retrieval.batch_top_k(data, data.where("id % 10 = 0"), 7).collect()
    for q in range(0, 400, 10):
        assert [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == _plain(x, q, 7)
    other = retrieval.batch_top_k(data, data.where("id % 10 = 0"), 1, other_group=True).collect()
    assert all(r.id == _plain(x, r.query_id, 1, np.arange(400) % 3 != r.query_id % 3)[0] for r in other) and len(other) == 40
