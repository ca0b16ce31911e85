"""A branch that is also read elsewhere in a plan keeps its rows together with those of the other branch."""

from pyspark.sql import functions as F

from strandspark.operators import positional, retrieval
from strandspark.plans import search
from strandspark.staging import united, written


def _branches(spark):
    """Two branches of 40 queries; the best ten of each, as batch search and the text index rank them."""
    best = lambda df, by: retrieval.ranked(df, [F.col(by).desc(), "id"], within=("query_id",)).where("rank <= 10")
    query = (F.col("id") % 40).alias("query_id")
    near = written(spark.range(400).select(query, (F.col("id") * 7 % 101).alias("id"), (F.col("id") * 0.37).alias("similarity")), "near")
    text = written(spark.range(800).select(query, (F.col("id") * 11 % 103).alias("id"), (F.col("id") * 0.17).alias("score")), "text")
    return best(near, "similarity"), best(text, "score")


def test_modes_of_one_branch_have_one_row_a_query(spark):
    near, text = _branches(spark)
    hybrid = retrieval.fused({"vector": near, "text": text}, 10, within=("query_id",))
    rows = [df.select(F.lit(mode).alias("mode"), "query_id", "rank", "id") for mode, df in (("vector", near), ("hybrid", hybrid))]
    groups = spark.range(500).select("id", (F.col("id") % 5).alias("grp"))
    for modes in (united(rows, "modes"), rows[0].unionByName(rows[1])):  # the second union has nothing that is read twice
        found = modes.join(groups, "id").join(groups.select(F.col("id").alias("query_id"), F.col("grp").alias("wanted")), "query_id")
        per = found.groupBy("mode", "query_id").agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(per) == 80 and {r.n for r in per} == {10}


def test_fused_ranks_are_those_of_plain_sums(spark):
    near, text = _branches(spark)
    share: dict[tuple[int, int], float] = {}
    for df in (near, text):
        for r in df.collect():
            share[r.query_id, r.id] = share.get((r.query_id, r.id), 0.0) + 1 / (60 + r["rank"]) / (2 / 61)
    found = retrieval.fused({"vector": near, "text": text}, 10, within=("query_id",))
    again = found.join(near.select("query_id", F.col("id").alias("near")), "query_id").groupBy("query_id").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("most"))
    assert all(r.n == r.most == 10 for r in again.collect())
    for q in range(40):
        plain = sorted((-round(s, 12), i) for (of, i), s in share.items() if of == q)[:10]
        assert [(-round(r.score, 12), r.id) for r in sorted((r for r in found.collect() if r.query_id == q), key=lambda r: r["rank"])] == plain


def test_texts_meet_their_groups_without_a_shuffle_beside_wide_vectors(spark, monkeypatch, tmp_path):
    spark.range(5_000).select(F.col("id").alias("vec_id"), (F.col("id") % 7).cast("int").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * 64 + i).cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).select(F.col("id").alias("item_id"), F.lit("word").alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    held = []
    monkeypatch.setattr(positional.TextIndex, "build", lambda self, docs, folder: held.append(docs) or self)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(100 << 10))  # less than the vectors, more than the groups
    try:
        search._indexed(spark, str(tmp_path))
        assert "BroadcastHashJoin" in held[0]._jdf.queryExecution().executedPlan().toString()
        assert {r.grp for r in held[0].collect()} == set(range(7)) and held[0].count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
