"""Layer checks: each is a row of layer, check, severity and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, layer: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """All aggregates in one pass, then a row for each."""
    one = df.agg(*[v.cast("long").alias(k) for k, (_, v) in values.items()])
    rows = F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(k).alias("check"), F.lit(s).alias("severity"), F.col(k).alias("value")) for k, (s, _) in values.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def duplicates(*keys: str) -> Column:
    """Rows beyond the first of their key; nulls in a key count as values."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))


def failed(report: DataFrame) -> DataFrame:
    return report.where((F.col("severity") == "hard") & (F.col("value") > 0))


class QualityError(ValueError):
    pass


def require_pass(report: DataFrame) -> None:
    """Raises with the first hard failures of a report, which has a row a check."""
    if bad := failed(report).limit(20).collect():
        raise QualityError("; ".join(f"{r.layer}: {r.check} = {r.value}" for r in bad))
