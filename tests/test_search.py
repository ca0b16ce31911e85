"""Both modes of retrieval against plain Python, and the checks of their settings."""

import numpy as np
import pytest

from strandspark.config import EngineConfig
from strandspark.operators import graph, positional, search

WORDS = "lock commit index session thread query table engine".split()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(WORDS, 12)) for _ in range(120)]
    x = rng.normal(size=(120, 6))
    docs = spark.createDataFrame([(i, i % 4, t, x[i].tolist()) for i, t in enumerate(texts)], "id long, grp long, text string, vector array<double>")
    asked = [(1000 + q, " ".join(rng.choice(WORDS, 2)), (x[q] + 0.3 * rng.normal(size=6)).tolist()) for q in range(6)]
    index = positional.TextIndex(spark, "for_search", "simple").build(docs, f"file://{tmp_path_factory.mktemp('index')}", buckets=2, block=16)
    yield x, texts, docs, asked, spark.createDataFrame(asked, "query_id long, text string, vector array<double>"), index
    index.drop()


def _plain(x, texts, asked, k, groups, hybrid):
    out = {}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    able = [i for i in range(len(x)) if groups is None or i % 4 in groups]
    for q, text, vector in asked:
        v = np.array(vector) / np.linalg.norm(vector)
        s = {i: round(float(unit[i] @ v), 9) for i in able}
        near = sorted(able, key=lambda i: (-s[i], i))[:k]
        if not hybrid:
            out[q] = [(i, s[i], s[i]) for i in near]
            continue
        terms, found = set(text.split()), []
        for i in able:
            places = [(at, w) for at, w in enumerate(texts[i].split(), 1) if w in terms]
            spans = [(a, b) for a in range(len(places)) for b in range(a, len(places)) if {w for _, w in places[a : b + 1]} == terms]
            least = [p for p in spans if not any(p != o and p[0] <= o[0] and o[1] <= p[1] for o in spans)]
            if least:
                found.append((-round(sum(0.1 / (1 + places[b][0] - places[a][0] - (b - a)) for a, b in least), 6), i))
        text_ranks = [i for _, i in sorted(found)[:k]]
        score = {i: min(1, sum(1 / (60 + r.index(i) + 1) for r in (near, text_ranks) if i in r) / (2 / 61)) for i in {*near, *text_ranks}}
        out[q] = [(i, s[i] if i in near else 0, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:k]]
    return out


@pytest.mark.parametrize("mode", ["vector", "hybrid"])
@pytest.mark.parametrize("groups", [None, (1, 2)])
def test_modes_and_scope(made, mode, groups):
    x, texts, docs, asked, questions, index = made
    rows = search.retrieved(EngineConfig(mode=mode, top_k=7), docs, questions, index, groups=groups).collect()
    for q, want in _plain(x, texts, asked, 7, groups, mode == "hybrid").items():
        got = [(r.id, r.similarity, r.score) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])]
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-8)


def test_through_graphs_and_errors(made, spark):
    _, _, docs, _, questions, index = made
    graphs = graph.build(docs)
    exact = {(r.query_id, r.id) for r in search.retrieved(EngineConfig(top_k=5), docs, questions).collect()}
    near = {(r.query_id, r.id) for r in search.retrieved(EngineConfig(top_k=5, depth=120), docs, questions, graphs=graphs).collect()}
    assert near == exact
    with pytest.raises(ValueError, match="text index"):
        search.retrieved(EngineConfig(mode="hybrid"), docs, questions)
    with pytest.raises(ValueError, match="a text for each"):
        search.retrieved(EngineConfig(mode="hybrid"), docs, questions.unionByName(spark.createDataFrame([(5, " ", [1.0] * 6)], questions.schema)), index)
    for bad in ({"mode": "text"}, {"depth": 0}, {"depth": 1001}, {"depth": True}, {"top_k": 2.0}, {"scope": (" ",)}, {"scope": ("a", "a")}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
