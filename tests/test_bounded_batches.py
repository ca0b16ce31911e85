"""What a task holds at a time is bounded: measured by the allocations of its function on one large batch."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from strandspark.operators import chunking, graph, positional, retrieval


def peak(rows) -> tuple[float, int]:
    """MB at most while the rows are taken one by one, and how many there were."""
    tracemalloc.start()
    try:
        n = sum(len(x) if isinstance(x, pd.DataFrame) else x.num_rows for x in rows)
        return tracemalloc.get_traced_memory()[1] / 2**20, n
    finally:
        tracemalloc.stop()


def test_nearest_rows_of_many_queries():
    rng = np.random.default_rng(1)
    frame = lambda n: pd.DataFrame({"id": np.arange(n), "grp": np.arange(n) % 5, "vector": list(rng.normal(size=(n, 8)))})
    visit = retrieval._visited(5, False)(frame(2_000))
    most, n = peak(visit(iter([frame(9_000)])))
    assert n == 10_000 and most < 60


def test_copies_are_no_larger_than_the_block():
    same = pd.DataFrame({"id": np.arange(5_000), "grp": 0, "vector": [np.ones(4)] * 5_000})
    visit = retrieval._visited(3, False)(same.iloc[:300])
    most, n = peak(visit(iter([same])))
    assert n == 900 and most < 120


def test_chunks_of_a_large_batch(monkeypatch):
    text = "word and word " * 1_000
    made = {}
    class Frame:
        columns = ["id", "text"]
        schema = type("S", (), {"fields": []})
        def select(self, *_):
            return self
        def mapInArrow(self, cut, _):  # noqa: N802
            made["cut"] = cut
    monkeypatch.setattr(chunking.F, "col", lambda _: type("C", (), {"cast": lambda self, _: None})())
    chunking.chunked(Frame())
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array([text] * 3_000)], ["id", "text"])
    most, n = peak(made["cut"](iter([batch])))
    assert n == 3_000 * 5 and most < 20


def test_counts_of_a_large_lot():
    lot = pd.DataFrame({"query_id": np.arange(16_000), "text": [f"w{i % 50} w{i % 7}" for i in range(16_000)]})
    docs = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([f"w{i} w{i % 7} x" for i in range(300)])], ["id", "text"])
    most, n = peak(positional.counted_terms(lot, 1)(iter([docs])))
    assert n == 16_000 and most < 100


def test_more_questions_are_more_tasks_of_a_graph_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(120)], "id long, grp long, vector array<double>")
    built = graph.build(rows)
    whole = graph.searched(built, rows, 3, 40)
    monkeypatch.setattr(graph, "VISITS", 30)
    some = graph.searched(built, rows, 3, 40)
    assert some.rdd.getNumPartitions() >= whole.rdd.getNumPartitions() + 3  # some four lots, not one
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in whole.collect()}
