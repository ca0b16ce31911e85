"""Digest trees: equal snapshots, what differs, leaves of bounded size."""

import pytest
from pyspark.sql import functions as F

from strandspark.operators import digests

KEYS, VALUES = ("repo", "number"), ("text",)


def _snapshot(spark, n=3000, parts=4):
    return spark.range(0, n, 1, parts).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 10)).alias("repo"), F.col("id").alias("number"), F.concat(F.lit("text "), F.col("id")).alias("text"))


def test_equal_snapshots_have_equal_roots_whatever_their_partitions(spark):
    a, b = _snapshot(spark), _snapshot(spark, parts=7).orderBy(F.rand(3))
    trees = [digests.digest_tree(x, "repo", KEYS, VALUES, levels=2) for x in (a, b)]
    roots = [sorted(map(tuple, digests.roots(t).collect())) for t in trees]
    assert roots[0] == roots[1] and [(g, n) for g, _, n in roots[0]] == [("hot", 2400), ("r8", 300), ("r9", 300)]
    assert digests.differing_leaves(*trees).count() == 0
    leaves = trees[0].where("level = 2")
    assert leaves.agg(F.max("n")).first()[0] <= 8 and leaves.agg(F.sum("n")).first()[0] == 3000


def test_changed_keys_are_named_and_few_leaves_looked_at(spark):
    old = _snapshot(spark)
    new = old.where("number <> 17").withColumn("text", F.when(F.col("number") == 1234, "other").otherwise(F.col("text"))).unionByName(spark.createDataFrame([("new", 1, "x"), (None, None, None)], "repo string, number long, text string"))
    got = {(r.repo, r.number, r.change) for r in digests.changed_keys(old, new, "repo", KEYS, VALUES).collect()}
    assert got == {("hot", 17, "deleted"), ("hot", 1234, "changed"), ("new", 1, "inserted"), (None, None, "inserted")}
    trees = [digests.digest_tree(x, "repo", KEYS, VALUES, levels=2) for x in (old, new)]
    assert digests.differing_leaves(*trees).where("group = 'hot'").count() == 2


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", None, None), (None, 1, "")], "repo string, number long, text string")
    root = lambda df: {r.group: (r.digest, r.n) for r in digests.roots(digests.digest_tree(df, "repo", KEYS, VALUES)).collect()}
    assert root(rows) != root(rows.distinct()) and root(rows)["a"][1] == 3 and root(rows)[None][1] == 1
    none = rows.limit(0)
    assert root(none) == {} and digests.changed_keys(none, none, "repo", KEYS, VALUES).count() == 0
    assert {r.change for r in digests.changed_keys(none, rows, "repo", KEYS, VALUES).collect()} == {"inserted"}
    with pytest.raises(ValueError):
        digests.differing_leaves(digests.digest_tree(rows, "repo", KEYS, VALUES, 1), digests.digest_tree(rows, "repo", KEYS, VALUES, 2))


def test_levels_follow_the_greatest_group():
    assert [digests._levels(n) for n in (0, 10**6, 10**7, 10**9, 10**13)] == [1, 1, 2, 3, 3]
