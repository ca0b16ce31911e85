"""Upserts: null keys, partitions by a column of the key, stored rows that aren't moved."""

import pytest
from pyspark.sql import functions as F

from strandspark.operators import tables


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "repo string, number long, text string")


def test_replay_with_null_keys_changes_nothing(spark):
    old = _rows(spark, ("a", 1, "x"), (None, 2, "y"), ("a", None, "z"), (None, None, None))
    once = tables.upserted(old, old, ("repo", "number"))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, old.collect()), key=str)
    assert {r.action for r in tables.upsert_actions(old, old, ("repo", "number"), ("text",)).collect()} == {"noop"}
    later = tables.upserted(old, _rows(spark, (None, 2, "new")), ("repo", "number"))
    assert sorted(map(tuple, later.collect()), key=str) == sorted([("a", 1, "x"), (None, 2, "new"), ("a", None, "z"), (None, None, None)], key=str)


@pytest.fixture
def table(spark):
    spark.sql("DROP TABLE IF EXISTS by_repo")
    held = tables.KeyedTable(spark, "by_repo", ("repo", "number"), by=("repo",), buckets=4)
    held.upsert(spark.range(600).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo"), F.col("id").alias("number"), F.lit("old").alias("text")))
    yield held
    spark.sql("DROP TABLE by_repo")


def test_a_batch_of_one_repository_rewrites_that_alone(spark, table):
    files = lambda: {f for f in spark.table("by_repo").inputFiles()}
    before = files()
    table.upsert(_rows(spark, ("r1", 1, "new"), ("r1", 9999, "more")))
    after = files()
    assert {f for f in before if "repo=r1" not in f} <= after and all("repo=r1" in f for f in before ^ after)
    got = {(r.repo, r.number): r.text for r in table.read().collect()}
    assert len(got) == 601 and got["r1", 1] == "new" and got["r1", 9999] == "more" and got["r0", 0] == "old" and got["r1", 4] == "old"
    table.upsert(_rows(spark, ("new", 1, "x")))
    assert table.read().count() == 602 and files() >= after


def test_stored_rows_are_not_shuffled(spark, table):
    new = spark.range(300).select(F.lit("r1").alias("repo"), F.col("id").alias("number"), F.lit("new").alias("text"))
    with tables._set(spark, **tables.JOINED_IN_PLACE):
        plan = table.merged(new)._jdf.queryExecution().executedPlan().toString()
    exchanges = [part for part in plan.split("Exchange")[1:]]
    assert len(exchanges) == 1 and "by_repo" not in exchanges[0].split("Project")[0] and "PartitionFilters" in plan
    stored = plan[plan.rindex("Scan parquet") :] if "by_repo" in plan[plan.rindex("Scan parquet") :] else plan[plan.index("Scan parquet") :]
    assert "Bucketed: true" in stored


def test_null_and_repeated_new_keys_are_errors(spark, table):
    for rows in ([("r1", None, "x")], [(None, 1, "x")], [("r1", 1, "x"), ("r1", 1, "y")]):
        with pytest.raises(ValueError, match="null or repeated key"):
            table.upsert(_rows(spark, *rows))
    with pytest.raises(ValueError):
        tables.KeyedTable(spark, "other", ("repo",), by=("text",))
    fresh = tables.KeyedTable(spark, "never_made", ("repo", "number"))
    with pytest.raises(ValueError, match="null or repeated key"):
        fresh.upsert(_rows(spark, ("a", 1, "x"), ("a", 1, "x")))
    assert fresh.read() is None


def test_columns_that_a_batch_lacks_stay(spark, table):
    table.add_columns(embedding="string")
    table.upsert(spark.createDataFrame([("r2", 2, "old", "vector")], "repo string, number long, text string, embedding string"))
    table.upsert(_rows(spark, ("r2", 2, "newer")))
    row = table.read().where("repo = 'r2' AND number = 2").first()
    assert (row.text, row.embedding) == ("newer", "vector")


def test_guarded_updates_fill_nulls_alone(spark):
    old = _rows(spark, ("a", 1, None), ("a", 2, "kept"), (None, 3, None), ("b", 4, None))
    updates = _rows(spark, ("a", 1, "y"), ("a", 1, "x"), ("a", 2, "new"), (None, 3, "none"), ("c", 9, "unknown"), ("b", 4, None))
    got = {(r.repo, r.number): r.text for r in tables.filled(old, updates, ("repo", "number"), "text").collect()}
    assert got == {("a", 1): "x", ("a", 2): "kept", (None, 3): None, ("b", 4): None}
