"""Plans as rows, and the exchanges of headline queries."""

import pytest
from pyspark.sql import functions as F

from strandspark.operators.plan_rows import plan_rows, summary
from strandspark.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_rows_of_an_executed_plan(spark, tmp_path):
    spark.range(1000).withColumn("g", F.col("id") % 7).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where("id >= 100").groupBy("g").count()
    rows = plan_rows(df).collect()
    assert sum(r.node == "Exchange" for r in rows) == 1 and [r.rows_out for r in rows if r.is_scan] == [1000]
    assert {r.id for r in rows} == set(range(len(rows))) and all(-1 <= r.parent < r.id for r in rows)
    assert [r.rows_out for r in rows if r.node == "HashAggregate"][0] == 7
    assert summary(df, run=True) == {"shuffles": 1, "broadcasts": 0, "scans": 1, "scanned": 1000}


@pytest.mark.parametrize(
    ("name", "shuffles", "scans"),
    [
        ("q_vector_topk", 0, 1),  # a bounded heap a task
        ("q_classify_rules", 1, 1),  # the few row groups are spread over the cores
        ("q_quality_silver", 2, 1),
        ("q_upsert_actions", 2, 2),
        ("q_resolution_argmax", 3, 3),
        ("q_latency_percentiles", 10, 3),  # ranges of distinct values, written once
    ],
)
def test_exchanges_of_headline_queries(spark, name, shuffles, scans):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = summary(QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found["broadcasts"] == 0
    assert (found["shuffles"], found["scans"]) == (shuffles, scans)
