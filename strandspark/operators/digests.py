"""Fingerprints of groups of any size by a tree of digests over ranges of keys, and what differs between two snapshots.

A row's digest is that of its key and values. Rows are dealt to leaves by the leading
bits of their key's hash; a leaf's digest is that of its rows in the order of their keys, and a
node's that of its children in order, level by level up to the group's root. The
number of leaves is a parameter, chosen from the expected size of the greatest group, so a leaf
is bounded and no task ever holds a group. Equal snapshots have equal roots, whatever
their files and partitions; unequal ones are compared from the root down, and only the
rows of leaves that differ are looked at.

Edge cases: nulls in keys and values are values; repeated rows count as often as
they occur; a group that one side lacks differs as a whole; an empty table has no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written

#: Children of a node, as a power of two, and levels below the root: 16 million leaves a group at most.
BITS, LEVELS = 8, 3


def _levels(rows_of_greatest: int, per_leaf: int = 4_096) -> int:
    """The fewest levels whose leaves hold that many rows on average."""
    levels = 1
    while levels < LEVELS and rows_of_greatest > per_leaf << (BITS * levels):
        levels += 1
    return levels


def _row_digest(columns) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def _in_order(order: Column, digest: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), digest.alias("h")))), lambda x: x["h"]), ""), 256)


def digest_tree(df: DataFrame, group: str, keys: tuple[str, ...], values: tuple[str, ...], levels: int | None = None) -> DataFrame:
    """A table of group, level (0: the root), node, digest and n, the number of rows below.

    A leaf's rows are combined by digests of (key, row), 64 characters each; a greater ``levels`` makes leaves smaller.
    """
    if levels is None:
        levels = _levels(df.groupBy(group).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    place = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    rows = df.select(F.col(group).alias("group"), F.shiftrightunsigned(place, 64 - BITS * levels).alias("node"), _row_digest(keys).alias("key"), _row_digest((*keys, *values)).alias("digest"))
    # a key with a third of all rows is one leaf's: equal rows are counted before they meet
    rows = rows.groupBy("group", "node", "key", "digest").agg(F.count(F.lit(1)).alias("n"))
    found = rows.groupBy("group", "node").agg(_in_order(F.col("key"), F.sha2(F.concat_ws(":", "digest", F.col("n").cast("string")), 256)).alias("digest"), F.sum("n").alias("n"))
    out = None
    for level in range(levels, -1, -1):
        found = written(found.select("group", F.lit(level).alias("level"), "node", "digest", "n"), f"digests-{level}")
        out = found if out is None else out.unionByName(found)
        found = found.groupBy("group", F.shiftrightunsigned("node", BITS).alias("node")).agg(_in_order(F.col("node"), F.col("digest")).alias("digest"), F.sum("n").alias("n"))
    return out


def roots(tree: DataFrame) -> DataFrame:
    return tree.where("level = 0").select("group", "digest", "n")


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """group and node of the leaves that differ between two trees of equal levels, found from the roots down."""
    levels = [t.agg(F.max("level")).first()[0] for t in (before, after)]
    if None not in levels and levels[0] != levels[1]:
        raise ValueError("the trees have different levels")
    open_at = None
    for level in range((max((x for x in levels if x is not None), default=-1)) + 1):
        sides = [t.where(F.col("level") == level).select("group", "node", F.col("digest").alias(name)) for t, name in ((before, "b"), (after, "a"))]
        if open_at is not None:
            up = open_at.select(F.col("group").alias("of"), F.col("node").alias("up"))
            sides = [s.join(up, F.col("group").eqNullSafe(F.col("of")) & (F.shiftrightunsigned("node", BITS) == F.col("up")), "left_semi") for s in sides]
        both = sides[0].alias("l").join(sides[1].alias("r"), [F.col("l.group").eqNullSafe(F.col("r.group")), F.col("l.node") == F.col("r.node")], "full")
        open_at = written(both.where("NOT (a <=> b)").select(F.coalesce("l.group", "r.group").alias("group"), F.coalesce("l.node", "r.node").alias("node")), f"differing-{level}")
    return open_at if open_at is not None else before.select("group", "node").limit(0)


def changed_keys(old: DataFrame, new: DataFrame, group: str, keys: tuple[str, ...], values: tuple[str, ...], levels: int = 2) -> DataFrame:
    """group, the keys and change: inserted, deleted or changed. Only rows of leaves that differ are joined."""
    trees = [digest_tree(df, group, keys, values, levels) for df in (old, new)]
    leaves = differing_leaves(*trees)
    place = F.shiftrightunsigned(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), 64 - BITS * levels)
    at = leaves.select(F.col("group").alias("_g"), F.col("node").alias("_node"))
    near = lambda df: df.withColumn("_node_of", place).join(at, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_node_of") == F.col("_node")), "left_semi").groupBy(group, *[k for k in keys if k != group]).agg(F.sum(F.xxhash64(*values).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    names = [group, *[k for k in keys if k != group]]
    both = near(old).alias("o").join(near(new).alias("n"), [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in names], "full")
    change = F.when(F.col("o.n").isNull(), "inserted").when(F.col("n.n").isNull(), "deleted").when(~F.struct("o.h", "o.n").eqNullSafe(F.struct("n.h", "n.n")), "changed")
    return both.select(*[F.when(F.col("n.n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in names], change.alias("change")).where("change IS NOT NULL")
