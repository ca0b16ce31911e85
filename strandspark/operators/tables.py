"""Change detection, upserts and deletes as joins, and catalog tables that are upserted by key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import written


def first_wins(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The row of least ``order`` for each key, combined before the shuffle; whole equal rows of that order are one."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def differs(columns: tuple[str, ...]) -> Column:
    """Null-safe difference of any compared column between o and n."""
    if not columns:
        return F.lit(False)
    pack = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns])
    return ~pack("o").eqNullSafe(pack("n"))


def _met(old: DataFrame, new: DataFrame, keys: tuple[str, ...], null_safe: bool = True) -> DataFrame:
    """Old rows as o and new ones as n, side by side by key; a null key meets a null key, unless there are none."""
    mark = lambda df: df.withColumn("_in", F.lit(True))
    return mark(old).alias("o").join(mark(new).alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) if null_safe else F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")


def upsert_actions(old: DataFrame, new: DataFrame, keys: tuple[str, ...], compared: tuple[str, ...]) -> DataFrame:
    """The keys with action: insert, update, noop, or keep for rows that only the old table has."""
    both = _met(old, new, keys)
    action = F.when(F.col("n._in").isNull(), "keep").when(F.col("o._in").isNull(), "insert").when(differs(compared), "update").otherwise("noop")
    return both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], action.alias("action"))


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...], compared: tuple[str, ...] | None = None, reset: dict[str, tuple[str, ...]] | None = None, null_safe: bool = True) -> DataFrame:
    """The table after an upsert: new rows win where a compared column differs.

    ``reset`` names columns that are kept from the old row only while other columns
    are unchanged, and are null otherwise (a stored embedding of changed text).
    """
    reset = reset or {}
    compared = compared or tuple(c for c in new.columns if c not in keys)
    both = _met(old, new, keys, null_safe)
    take_new = F.col("n._in").isNotNull() & (F.col("o._in").isNull() | differs(compared))
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c in reset:
            out.append(F.when(F.col("n._in").isNull() | (F.col("o._in").isNotNull() & ~differs(reset[c])), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def filled(old: DataFrame, updates: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """The table after a set-based update of one column that is guarded: only rows where it is null take the update's value.

    Of several updates of a key the least value counts; updates of keys that the table lacks do nothing, and null keys meet none.
    """
    one = updates.groupBy(*keys).agg(F.min(column).alias("_value"))
    return old.join(one, list(keys), "left").select(*[F.coalesce(c, "_value").alias(c) if c == column else F.col(c) for c in old.columns])


def without_keys(df: DataFrame, gone: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Delete by key set; applied to a child table it is the cascade."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def changed_or_pending(source: DataFrame, derived: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Source keys with a reason: new (nothing derived), changed (a stale hash), pending (an empty payload).

    One aggregate of the derived rows and one join; ``source`` has hash, ``derived`` hash and payload.
    """
    per = derived.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.coalesce("hash", F.lit(""))).alias("hashes"), F.count_if(F.col("payload").isNull()).alias("n_open"))
    at = source.join(per, list(keys), "left")
    stale = F.exists(F.col("hashes"), lambda h: h != F.coalesce(F.col("hash"), F.lit("")))
    reason = F.when(F.col("n").isNull(), "new").when(stale, "changed").when(F.col("n_open") > 0, "pending")
    return at.select(*keys, reason.alias("reason")).where("reason IS NOT NULL")


#: A table that is bucketed by a part of the join's keys needn't be shuffled by all of them.
JOINED_IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class KeyedTable:
    """A catalog table with one row a key, in partitions that an upsert can overwrite one by one.

    The partitions are the values of ``by``, columns of the key such as a repository; without them, ``parts`` hashes
    of the key. An upsert joins only the partitions that the new rows fall in, stages the
    result in the shared folder, and has Spark overwrite these partitions. With ``buckets``,
    each partition is bucketed by the key, and the join moves the new rows to the stored
    ones, which are not shuffled. A failed upsert changes
    nothing before that last step, and a repeated one changes nothing at all. One writer
    at a time: later ones win. Null keys and repeated keys among the new rows are errors.
    """

    def __init__(self, spark: SparkSession, name: str, keys: tuple[str, ...], parts: int = 64, by: tuple[str, ...] = (), buckets: int = 0):
        if set(by) - set(keys):
            raise ValueError("partitions must be columns of the key")
        self.spark, self.name, self.keys, self.parts, self.by, self.buckets = spark, name, keys, parts, by, buckets
        self.split = by or ("_part",)
        self.within = tuple(k for k in keys if k not in by) or keys

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df if self.by else df.withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def _checked(self, new: DataFrame) -> DataFrame:
        """The new rows as a table; an error if a key is null or there more than once."""
        new = written(self._dealt(new), "new-rows")
        bad = new.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where(" OR ".join(["n > 1", *(f"`{k}` IS NULL" for k in self.keys)]))
        if row := bad.first():
            raise ValueError(f"{self.name}: a null or repeated key among the new rows: {row.asDict()}")
        return new

    def read(self) -> DataFrame | None:
        """The rows, or None before the first upsert."""
        return self.spark.table(self.name).drop("_part") if self.spark.catalog.tableExists(self.name) else None

    def add_columns(self, **types: str) -> None:
        """Adds columns that aren't there yet; earlier rows have null."""
        held = self.spark.table(self.name).columns
        if missing := [f"`{c}` {t}" for c, t in types.items() if c not in held]:
            self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({', '.join(missing)})")

    def touched(self, new: DataFrame) -> DataFrame:
        """The stored rows of the partitions that ``new`` falls in: those partitions alone are read, and they aren't moved.

        Their names are collected: as many as a batch has repositories, or hash parts, which bounds what one
        upsert rewrites.
        """
        names = [tuple(r) for r in new.select(*self.split).distinct().collect()]
        one = lambda r: reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(self.split, r, strict=True)])
        return self.spark.table(self.name).where(reduce(lambda a, b: a | b, map(one, names), F.lit(False)))

    def upsert(self, new: DataFrame, compared: tuple[str, ...] | None = None, reset: dict[str, tuple[str, ...]] | None = None) -> None:
        """``upserted`` over the table's rows; columns that the new rows lack stay as they are."""
        new = self._checked(new)
        if not self.spark.catalog.tableExists(self.name):
            writer = new.repartition(*self.split, *self.within).write.partitionBy(*self.split).format("parquet")
            (writer.bucketBy(self.buckets, *self.within).sortBy(*self.within) if self.buckets else writer).saveAsTable(self.name)
            return
        held = self.spark.table(self.name)
        columns = [c for c in held.columns if c != "_part"]
        with _set(self.spark, **JOINED_IN_PLACE):
            after = written(self.merged(new, compared, reset), "upserted")
        with _set(self.spark, **{"spark.sql.sources.partitionOverwriteMode": "dynamic"}):  # inserting into a catalog table heeds the session's setting only
            self._dealt(after.select(*columns)).select(*held.columns).write.mode("overwrite").insertInto(self.name)

    def merged(self, new: DataFrame, compared: tuple[str, ...] | None = None, reset: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
        """What the touched partitions hold after an upsert. Keys aren't null here, so the join is by plain equality, which bucketing serves."""
        held = self.spark.table(self.name)
        columns = [c for c in held.columns if c != "_part"]
        for c in set(columns) - set(new.columns):  # kept where the key is known
            new = new.withColumn(c, F.lit(None).cast(held.schema[c].dataType))
            reset = {c: (), **(reset or {})}
        compared = compared or tuple(c for c in columns if c not in self.keys and c not in (reset or {}))
        return upserted(self.touched(new).select(*columns), new.select(*columns), self.keys, compared, reset, null_safe=False)

    def replace(self, parents: DataFrame, rows: DataFrame) -> None:
        """Rows of the keys in ``parents``, columns of the key that hold the partition's, give way to ``rows``; in one step for each touched partition."""
        if not set(self.by) <= set(parents.columns) <= set(self.keys) or not self.by:
            raise ValueError("parents must have the partitions' columns, and others of the key")
        if not self.spark.catalog.tableExists(self.name):
            self.upsert(rows)
            return
        rows, held = self._checked(rows), self.spark.table(self.name)
        kept = without_keys(self.touched(parents), parents, tuple(parents.columns)).select(*held.columns)
        after = written(kept.unionByName(rows.select(*held.columns)), "replaced")
        with _set(self.spark, **{"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            after.write.mode("overwrite").insertInto(self.name)
