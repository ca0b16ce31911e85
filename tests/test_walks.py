"""Walks abreast through a graph against a plain search of one query and depth; depths share a walk, parts don't share a task."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.operators import graph
from strandspark.plans import experiments

DEPTHS = (1, 7, 40, 150)


def _graph(n=1500, wide=12, seed=3) -> graph.Graph:
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (30, wide))[rng.integers(0, 30, n)] + rng.normal(0, 0.3, (n, wide))
    x[50:90] = x[50]  # one node
    return graph.Graph.unpacked(graph.Graph(graph._unit(x), np.arange(n), np.arange(n) % 3).packed())


def _plain(g: graph.Graph, q: np.ndarray, depth: int) -> tuple[list[tuple[float, int]], int]:
    """The ``depth`` best nodes of a best-first search, as similarity and node, and how many were scored."""
    links = [[to[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] for begin, to in g.levels]
    at, best, met = 0, float(g.x[0] @ q), {0}
    for level in reversed(links[1:]):
        while level[at]:
            met.update(level[at])
            t, other = max((float(g.x[o] @ q), o) for o in level[at])
            if t <= best:
                break
            at, best = other, t
    kept, open_at, seen = [(best, at)], [(-best, at)], {at}
    while open_at:
        s, node = heapq.heappop(open_at)
        if len(kept) == depth and -s < kept[0][0]:
            break
        for other in [o for o in links[0][node] if o not in seen]:
            seen.add(other)
            t = float(g.x[other] @ q)
            if len(kept) < depth:
                heapq.heappush(kept, (t, other))
            elif t > kept[0][0]:
                heapq.heapreplace(kept, (t, other))
            else:
                continue
            heapq.heappush(open_at, (-t, other))
    return kept, len(met | seen)


@pytest.mark.parametrize("ahead", [1, 256])
def test_each_depth_of_a_walk_is_a_search_of_its_own(monkeypatch, ahead):
    monkeypatch.setattr(graph, "AHEAD", ahead)  # with little room what waits is thinned out at every step
    g = _graph()
    asked = graph._unit(np.random.default_rng(4).normal(0, 1, (25, 12)))
    opened, nodes, ends, scored = g.walks(asked, DEPTHS)
    for i, q in enumerate(asked):
        for j, depth in enumerate(DEPTHS):
            kept, n = _plain(g, q, depth)
            best = nodes[i, np.argsort(-opened[i, : ends[i, j]], kind="stable")[:depth]]
            assert sorted(best.tolist()) == sorted(node for _, node in kept) and scored[i, j] == n


@pytest.mark.parametrize("scope", [None, (1,)])
def test_best_rows_are_those_of_all_rows_of_the_nodes(scope):
    g = _graph()
    own = np.array([50, 51, 89, 200])
    asked = np.stack([g.x[np.searchsorted(g.first, np.flatnonzero(g.ids == i)[0], side="right") - 1] for i in own])
    opened, nodes, ends, _ = g.walks(asked, DEPTHS)
    for j, depth in enumerate(DEPTHS):
        query, ids, groups, similarity = graph._best_rows(opened, nodes, ends[:, j], depth, 9, own, g.allowed(scope))
        for i in range(len(own)):
            kept, _ = _plain(g, asked[i], depth)
            rows = [(-round(s, 9), int(g.ids[r])) for s, node in kept for r in range(g.first[node], g.first[node + 1]) if g.ids[r] != own[i] and (scope is None or g.groups[r] in scope)]
            assert [(-s, r) for s, r in zip(similarity[query == i], ids[query == i], strict=True)] == sorted(rows)[:9] and (groups == ids % 3).all()


def test_a_part_is_a_task_and_a_sweep_visits_it_once(spark, monkeypatch):
    x = np.random.default_rng(5).normal(0, 1, (900, 6))
    data = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, grp long, vector array<double>")
    graphs = graph.build(data, part_rows=100)
    assert graphs.count() == len(graphs.inputFiles()) == 9
    one = graph.searched(graphs, data.where("id < 20"), 3, 40)
    all_depths = graph.swept(graphs, data.where("id < 20"), 3, (100, 40, 10)).where("depth = 40").drop("depth")
    assert one.count() == all_depths.count() > 0 and one.exceptAll(all_depths).count() == 0
    calls, rounds = [], graph.in_rounds
    monkeypatch.setattr(graph, "in_rounds", lambda *a, **k: calls.append(1) or rounds(*a, **k))
    assert experiments.q_index_recall(spark, "/root/testdata/sf0.001").agg(F.count(F.lit(1))).first()[0] == 4 and len(calls) == 1
