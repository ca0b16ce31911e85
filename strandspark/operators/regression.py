"""Regressions over frozen evidence: reserved calls, saved answers finished again and checked, scores of reviewed cases alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import content_hash
from . import answers
from .ordering import cumulated

#: Tokens that a call's framing takes at most, beside a token for each byte of its messages.
FRAMING_TOKENS = 512
#: An inline citation or a link.
INLINE_SOURCE = r"\[|\]\(|https?://"
CHECKS = ("in_both", "evidence_same", "marker_only", "message_exact", "no_inline_sources", "sources_same", "count_same")


def reservations(calls: DataFrame, text: Column, output_cap: int, input_rate: str, output_rate: str) -> DataFrame:
    """``calls`` with input_bound and reserved: what a call costs at most, from decimal rates for a million tokens.

    No tokenizer makes more tokens than bytes, so the bound needs none. A null text has only its framing.
    """
    rate = lambda tokens, x: tokens.cast("decimal(12,0)") * F.lit(x).cast("decimal(10,6)")
    bound = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + FRAMING_TOKENS
    total = (rate(bound, input_rate) + rate(F.lit(output_cap), output_rate)) / F.lit(1_000_000).cast("decimal(7,0)")
    return calls.withColumn("input_bound", bound).withColumn("reserved", total.cast("decimal(18,10)"))


def reserved_within(calls: DataFrame, by: list[Column], budget: str) -> DataFrame:
    """``calls`` that have reservations, with in_budget: whether all reservations before and the own one stay within an exact budget."""
    run = cumulated(calls, by, {"reserved": "_before"})
    return run.withColumn("in_budget", F.col("_before") + F.col("reserved") <= F.lit(budget).cast("decimal(18,10)")).drop("_before")


def frozen(cases: DataFrame, evidence: str = "evidence") -> DataFrame:
    """``cases`` with the digest of question and evidence, in order, that a later run is held against."""
    return cases.withColumn("input_digest", content_hash(question=F.col("question"), evidence=F.col(evidence)))


def freeze(cases: DataFrame, folder: str) -> DataFrame:
    """The frozen cases, written once: an error if the folder has a run, so no paid call is repeated over another's inputs.

    Ids must be there and be distinct.
    """
    if not cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR case_id IS NULL").isEmpty():
        raise ValueError("case ids are null or repeated")
    frozen(cases).write.mode("errorifexists").parquet(folder)
    return cases.sparkSession.read.parquet(folder)


def replayed(cases: DataFrame, saved: DataFrame, marker: str, message: str, excerpts: Column, sources: Column) -> DataFrame:
    """Saved raw answers (case_id, raw) finished with the evidence of ``cases`` as a service would: case_id, input_digest, raw, answer, sources."""
    held = frozen(cases).join(saved.select("case_id", "raw"), "case_id")
    return held.select("case_id", "input_digest", "raw", answers.finalized(F.col("raw"), excerpts, marker, message).alias("answer"), sources.alias("sources"))


def abstention_checks(before: DataFrame, finished: DataFrame, marker: str, message: str, sources: Column) -> DataFrame:
    """case_id, each of CHECKS, and passed, for frozen cases (case_id, input_digest, evidence) and their finished answers.

    ``sources`` are those that the frozen evidence demands, in order; what the run lists
    must equal them. A case of one side alone, or without an answer, fails.
    """
    old, new = before.select("case_id", F.col("input_digest").alias("_digest"), sources.alias("_sources")), finished.withColumn("_in", F.lit(True))
    both = old.withColumn("_old", F.lit(True)).join(new, "case_id", "full")
    said = {
        "in_both": F.col("_in") & F.col("_old"), "evidence_same": F.col("input_digest") == F.col("_digest"), "marker_only": F.regexp_replace("raw", r"^\s+|\s+$", "") == marker,
        "message_exact": F.col("answer") == message, "no_inline_sources": ~F.col("answer").rlike(INLINE_SOURCE), "sources_same": F.col("sources") == F.col("_sources"), "count_same": F.size("sources") == F.size("_sources"),
    }
    rows = both.select("case_id", *[F.coalesce(said[c], F.lit(False)).alias(c) for c in CHECKS])
    every = F.lit(True)
    for c in CHECKS:
        every = every & F.col(c)
    return rows.withColumn("passed", every)


def check_report(checks: DataFrame) -> DataFrame:
    """A row for each check, and one for all: check, n_cases, n_failed, and the least failing id."""
    names = (*CHECKS, "passed")
    one_pass = checks.agg(F.count(F.lit(1)).alias("n_cases"), *[F.struct(F.count_if(~F.col(c)).alias("n_failed"), F.min(F.when(~F.col(c), F.col("case_id"))).alias("first_failed")).alias(c) for c in names])
    return one_pass.select("n_cases", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c)["n_failed"].alias("n_failed"), F.col(c)["first_failed"].alias("first_failed")) for c in names])).alias("x")).select("x.check", "n_cases", "x.n_failed", "x.first_failed")


def require_reviewed(cases: DataFrame, n: int) -> DataFrame:
    """The cases that expect an answer, of which there must be ``n``, all reviewed by hand."""
    some = cases.where(~F.coalesce(F.col("expected_abstain"), F.lit(False)))
    found = some.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("verification_status").eqNullSafe(F.lit("manually_verified"))).alias("other")).first()
    if found.n != n or found.other:
        raise ValueError(f"{found.n} cases expect an answer, {found.other} of them not reviewed; wanted are {n} reviewed ones")
    return some


def reviewed_scores(cases: DataFrame, metrics: DataFrame, best: DataFrame, cutoff: float) -> DataFrame:
    """repository (null: all), n_cases, means and number of hits, and how many a frozen cutoff refuses wrongly, of reviewed cases.

    ``best`` has case_id and the score of the best result; a case without one is refused.
    A case counts under the repository that it expects first, and only if it expects one.
    """
    held = cases.where("verification_status = 'manually_verified'").select("case_id", F.get("expected_issues", F.lit(0))["repository"].alias("repository"))
    rows = held.join(metrics.where("applicable"), "case_id").join(best.select("case_id", "score"), "case_id", "left")
    under = F.when(F.col("repository").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), F.col("repository")))
    refused = F.coalesce(F.col("score") < cutoff, F.lit(True))
    of = rows.withColumn("_of", F.explode(under)).groupBy(F.col("_of").alias("repository"))
    return of.agg(F.count(F.lit(1)).alias("n_cases"), F.avg("hit").alias("hit"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.sum("hit").alias("n_hits"), F.count_if(refused).alias("n_refused"))
