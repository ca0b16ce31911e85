"""Ranks of whole questions against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandspark.operators import fulltext
from strandspark.plans import catalogue

WORDS = "connect connected query table index session engine thread lock commit the of driver".split()


def density(places, n):
    latest, begun, total = {}, -1, 0.0
    for at, term in sorted(places):
        latest[term] = at
        if len(latest) == n and min(latest.values()) > begun:
            begun = min(latest.values())
            total += 1 / (at - begun + 1)
    return round(total, 6)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_density_ranked(spark, k):
    rng = random.Random(k)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 25)))) for i in range(30)]
    asked = [(0, "the index of connected sessions, locks and commits"), (1, "driver"), (2, "the of")]
    docs_df, asked_df = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    at = defaultdict(lambda: defaultdict(list))
    for r in fulltext.lexemes(docs_df).collect():
        at[r.id][r.lexeme].append(r.at)
    want_of = defaultdict(set)
    for r in fulltext.lexemes(asked_df.withColumnRenamed("query_id", "id")).collect():
        want_of[r.id].add(r.lexeme)
    want = []
    for q, lexemes in want_of.items():
        rows = []
        for d, held in at.items():
            mine = sorted(lexemes & set(held))
            places = [(p, x) for x in mine for p in held[x]]
            if mine:
                rows.append((-len(mine), -density(places, len(mine)), d, len(places)))
        want += [(q, i + 1, d, -n, hits, -s) for i, (n, s, d, hits) in enumerate(sorted(rows)[:k])]
    got = [tuple(r) for r in fulltext.density_ranked(docs_df, asked_df, k).select("query_id", "rank", "id", "n_lexemes", "n_hits", F.col("score")).collect()]
    assert sorted(got) == [pytest.approx(x) for x in sorted(want)] and {x[0] for x in got} == {0, 1}


def test_words_after_the_second_count(spark, tmp_path):
    made = [(0, "se que nothing of this is here"), (1, "se que and then the zebra meets a walrus"), (2, "se que se que se que")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "se que zebra walrus")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert catalogue.QUERIES["q_fts_cover_density"](spark, str(tmp_path)).where("rank = 1").first().doc_id == 1
    rng = random.Random(1)
    spark.createDataFrame([(i, i % 2, [rng.random() for _ in range(4)]) for i in range(3)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r for r in catalogue.QUERIES["q_hybrid_rrf_questions"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2} and got[0].n_branches == 1 and got[1].n_branches == got[2].n_branches == 2
    assert got[1].score in (pytest.approx(1), pytest.approx((1 / 61 + 1 / 62) / (2 / 61)))
