"""Running sums and ranks over a whole order without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import written


def cumulated(df: DataFrame, by: list[Column], sums: dict[str, str], within: tuple[str, ...] = ()) -> DataFrame:
    """For each column in ``sums``, under its new name, the sum over all rows before, in the order of ``by``, of the same ``within``.

    Rows are split by ranges of the order and written once; the sums of whole ranges, a
    row for each range and group, are added to those within a range. Rows that are equal
    in ``by`` lie in one range, so the order must tell rows apart where many are equal.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *within, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    held = ranged.groupBy("_range", *within).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    base = held.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_of_{c}") for c in within], *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in sums])
    inside = Window.partitionBy("_range", *within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in within]]
    run = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums]).join(base, same)
    return run.select(*df.columns, *[(F.col(f"_base_{c}") + F.col(f"_in_{c}")).alias(name) for c, name in sums.items()])


def global_rank(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """With the rank, from 1, of every row in a total order."""
    return cumulated(df.withColumn("_one", F.lit(1).cast("long")), by, {"_one": "_before"}).drop("_one").withColumn(name, F.col("_before") + 1).drop("_before")


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``group``, n, mean, and percentiles that are interpolated at (n - 1) times the share.

    Distinct values with their counts are ranked by ranges; of them only the two
    neighbours of each place are kept, so no group is held in one task. Nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(group).agg(F.sum("_n").alias("n"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean")).withColumnRenamed(group, "_group")
    at = cumulated(counts, [F.col(value)], {"_n": "_before"}, (group,)).join(totals, F.col(group).eqNullSafe(F.col("_group")))
    place = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    held = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col(value).cast("double")))
    found = at.groupBy(group).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *[held(edge(p)).alias(f"_{side}_{name}") for name, p in place.items() for side, edge in (("low", F.floor), ("high", F.ceil))])
    between = lambda name: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (place[name] - F.floor(place[name]))
    return found.select(group, "n", "mean", *[between(name).alias(name) for name in shares])
