"""Watermarked incremental runs: what is new by key, gates, idempotent upserts, monotone watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import require_pass
from ..staging import written
from ..operators.tables import KeyedTable


def advanced(watermarks: DataFrame, seen: DataFrame) -> DataFrame:
    """key and watermark after a run: the greater of the stored and the seen one."""
    return watermarks.unionByName(seen.select("key", "watermark")).groupBy("key").agg(F.max("watermark").alias("watermark"))


def since(rows: DataFrame, watermarks: DataFrame, key: str, at: str) -> DataFrame:
    """Rows at or after their key's watermark; keys without one are read whole."""
    marks = watermarks.select(F.col("key").alias("_key"), F.col("watermark").alias("_mark"))
    joined = rows.join(marks, F.col(key) == F.col("_key"), "left")
    return joined.where(F.col("_mark").isNull() | (F.col(at) >= F.col("_mark"))).drop("_key", "_mark")


def within_quota(rows: DataFrame, keys: list, at: str, most: int, tie: str) -> DataFrame:
    """The first ``most`` rows of each key and day."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(*keys, F.to_date(at)).orderBy(at, tie)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def run_batch(batch: DataFrame, target: KeyedTable, marks: KeyedTable, key: str, at: str, gate: Callable[[DataFrame], DataFrame]) -> None:
    """One micro-batch: gate, upsert the newest row of each of the target's keys, and only then the watermarks.

    A replay upserts equal rows and leaves the greatest watermark, so it changes nothing.
    Late rows aren't dropped: a later version of a row overwrites an earlier one whenever
    it comes, and an earlier one never overwrites a later one.
    """
    ids = target.keys
    rest = [c for c in batch.columns if c not in ids]
    newest = batch.groupBy(*ids).agg(F.max_by(F.struct(*rest), F.struct(at, F.xxhash64(*rest))).alias("r")).select(*ids, "r.*").select(*batch.columns)
    newest = written(newest, "newest")
    require_pass(gate(newest))
    held = target.read()
    if held is not None:
        known = held.select(*[F.col(c).alias(f"_{c}") for c in ids], F.col(at).alias("_at"))
        earlier = newest.join(known, [F.col(c) == F.col(f"_{c}") for c in ids]).where(F.col(at) < F.col("_at")).select(*ids)
        newest = written(newest.join(earlier, list(ids), "left_anti"), "not-late")
    target.upsert(newest)
    seen = batch.groupBy(F.col(key).alias("key")).agg(F.max(at).alias("watermark"))
    held = marks.read()
    marks.upsert(seen if held is None else advanced(held, seen))


def start(stream: DataFrame, checkpoint: str, **how):
    """Runs all that has arrived through ``run_batch`` and stops; a scheduler calls it again."""
    return stream.writeStream.foreachBatch(lambda batch, _: run_batch(batch, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with ``late``, a stream may finish windows by watermark."""
    at = events.withWatermark("ts", late) if late else events
    return at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
