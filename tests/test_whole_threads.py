"""Threads beyond 899 of one source are cleaned as well."""

from collections import Counter

from strandspark.plans import catalogue


def test_no_document_is_lost_to_a_small_key(spark, tmp_path):
    n = 2_000
    spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'one' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 0, "said")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalogue.QUERIES["q_clean_threads_all"](spark, str(tmp_path)).collect()
    good = [r for r in rows if r.reason == "valid"]
    want = {d for d in range(1, n) if d % 17 != 3}
    assert sorted(r.seq for r in good) == sorted(2 * d for d in want)
    assert Counter(r.reason for r in rows)["duplicate key"] == sum(d % 50 == 7 for d in want)
    assert len({r.content_hash for r in good}) == len({r.body for r in good}) == len(want) and [r.seq for r in good if r.resolution] == [10]
