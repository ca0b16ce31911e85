"""Postings as lists by block: what is moved, rounding, and counts of gold documents against all ranks."""

import numpy as np
from pyspark.sql import functions as F

from strandspark.operators import positional
from strandspark.operators.positional import TextIndex


def test_halves_are_rounded_up():
    assert positional._rounded(np.array([0.0015625, 0.3, 0.1 / 64, 0.1 * 3, 0.0000005])).tolist() == [0.001563, 0.3, 0.001563, 0.3, 0.000001]


def test_matches_are_counted_where_they_lie(spark, tmp_path, monkeypatch):
    docs = [(i, i % 3, "lock table " * (i % 7 + 1) + "word " * (i % 5)) for i in range(200)] + [(7, None, "table lock")]
    asked = [(7, "table lock"), (500, "lock"), (8, "nowhere")]
    monkeypatch.setattr(positional, "LOT", 2)  # more than one lot of queries
    index = TextIndex(spark, "counted", "simple").build(spark.createDataFrame(docs, "id long, grp long, text string"), f"file://{tmp_path}/t", buckets=3, block=16)
    try:
        queries = spark.createDataFrame(asked, "query_id long, text string")
        for mode in positional.MODES:
            every = [(r.query_id, r.id) for r in index.top_k(queries, 1000, mode).orderBy("query_id", "rank").collect()]
            want = set()
            for q, _ in asked:
                ids = [i for n, i in every if n == q]
                want.add((q, len(ids), ids.index(q) + 1 if q in ids else None))
            got = index.gold_ranks(queries, queries.select("query_id", F.col("query_id").alias("id")), mode)
            assert {tuple(r) for r in got.select("query_id", "n_candidates", "gold_rank").collect()} == want
        asked = index.asked(queries)
        plan = index.ranked_in(index._bounds(asked, "any"), asked, "any", None, 3)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan.split("Exchange")[0] and "ats" not in plan  # no positions where none are needed
        assert index.ranked_in(index._bounds(asked, "any"), asked, "any", None, 3).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * index.blocks.select("block").distinct().count()
    finally:
        index.drop()


def test_rows_of_a_block():
    rows = positional._block_rows(5, [3, 4], [None, 1], [np.array([0, 1, 0, 2], np.int32), np.array([2], np.int32)], positional._Codes({"cats": 0, "the": 1, "run": 2}), "english").to_pylist()
    assert rows == [
        {"term": "", "block": 5, "ids": [3, 4], "grps": [None, 1], "docs": [], "ns": [], "ats": []},
        {"term": "cat", "block": 5, "ids": [], "grps": [], "docs": [0], "ns": [2], "ats": [1, 3]},
        {"term": "run", "block": 5, "ids": [], "grps": [], "docs": [0, 1], "ns": [1, 1], "ats": [4, 1]},
    ]
