"""Evaluation metrics: confusion counts, threshold calibration, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written
from .ordering import cumulated, percentiles


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """label, support, predicted, correct, precision, recall and f1; absent denominators give 0."""
    sides = counts.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("x"), (F.col("actual") == F.col("predicted")).alias("same"), "n")
    per = sides.groupBy("x.label").agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"), F.coalesce(F.sum(F.when(F.col("same") & (F.col("x.support") > 0), F.col("n"))), F.lit(0)).cast("long").alias("correct"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.select("*", rate(F.col("correct"), F.col("predicted")).alias("precision"), rate(F.col("correct"), F.col("support")).alias("recall"))
    return per.select("*", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, and the mean F1 of the classes that have rows."""
    counts = confusion(df, actual, predicted)
    whole = counts.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    macro = precision_recall(counts).where("support > 0").agg(F.avg("f1").alias("macro_f1"))
    return whole.crossJoin(F.broadcast(macro))  # one row each


def best_threshold(df: DataFrame) -> DataFrame:
    """threshold and balanced accuracy of the best cutoff for (score, answerable): refuse what is below it.

    Cutoffs are 0, 1 and the midpoints of neighbouring scores (1 after the last); ties go to
    the lowest. Counts below a midpoint are running sums over the distinct scores, taken by
    ranges of the score, so no cutoff meets all rows and no task all scores.
    """
    scores = written(df.groupBy("score").agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u")), "scores")
    totals = scores.agg(F.sum("a").alias("all_a"), F.sum("u").alias("all_u"))
    run = written(cumulated(scores, [F.col("score")], {"a": "before_a", "u": "before_u"}), "running-scores")
    # neighbours share a count: of the rows up to the lower score, and of those before the higher one
    lower = run.select((F.col("before_a") + F.col("a")).alias("below_a"), (F.col("before_u") + F.col("u")).alias("below_u"), F.col("score").alias("low"))
    higher = run.select(F.col("before_a").alias("below_a"), F.col("before_u").alias("below_u"), F.col("score").alias("next"))
    pairs = lower.join(higher, ["below_a", "below_u"], "left").select("low", F.coalesce("next", F.lit(1.0)).alias("next"), "below_a", "below_u")
    middles = pairs.where("low < next").select(((F.col("low") + F.col("next")) / 2).alias("t"), "below_a", "below_u")
    below = lambda t: scores.agg(F.lit(float(t)).alias("t"), F.coalesce(F.sum(F.when(F.col("score") < t, F.col("a"))), F.lit(0)).alias("below_a"), F.coalesce(F.sum(F.when(F.col("score") < t, F.col("u"))), F.lit(0)).alias("below_u"))
    every = middles.unionByName(below(0)).unionByName(below(1)).crossJoin(F.broadcast(totals))  # totals: one row
    rated = every.select("t", "below_a", "below_u", ((F.col("below_u") / F.col("all_u") + (F.col("all_a") - F.col("below_a")) / F.col("all_a")) / 2).alias("balanced_accuracy"))
    return rated.orderBy(F.col("balanced_accuracy").desc(), "t").limit(1).select(F.col("t").alias("threshold"), "balanced_accuracy", F.col("below_u").cast("long").alias("correctly_refused"), F.col("below_a").cast("long").alias("wrongly_refused"))


def latency_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Linear-interpolated percentiles and the mean."""
    return percentiles(df, group, value, {"p50": 0.5, "p95": 0.95})


def performance_summary(df: DataFrame, group: str, latency: str, cost: str, refused: str) -> DataFrame:
    """By group: n, p50, p95 and mean latency, the exact cost in all and on average, and how many requests were refused."""
    times = latency_summary(df, group, latency)
    sums = df.groupBy(F.col(group).alias("_group")).agg(F.sum(cost).alias("cost"), F.avg(cost).alias("mean_cost"), F.count_if(refused).alias("n_refused"))
    return times.join(sums, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def within_spend(calls: DataFrame, by: list[Column], cost: str, budget: float) -> DataFrame:
    """The calls, in an order that tells them apart, that a budget allows: what is spent before, and the call itself, stay within it."""
    return cumulated(calls, by, {cost: "_spent"}).where(F.col("_spent") + F.col(cost) <= budget).drop("_spent")
