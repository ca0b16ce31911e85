"""Frozen cases are written once, answers are finished and checked against them, reviewed cases are scored alone."""

import pytest
from pyspark.sql import functions as F

from strandspark.operators import regression

CASE = "case_id string, question string, evidence array<struct<source: string, excerpt: string>>"
MARKER, MESSAGE = "[NONE]", "Nothing here."


def sources():
    return F.transform("evidence", lambda x: x["source"])


def finished_of(cases, saved):
    return regression.replayed(cases, saved, MARKER, MESSAGE, F.transform("evidence", lambda x: x["excerpt"]), sources())


@pytest.fixture
def made(spark):
    return spark.createDataFrame([(c, f"why {c}", [("u1", "one"), ("u2", None)]) for c in "abcde"] + [("empty", None, [])], CASE)


def run(spark, made, raws, saw=None):
    before = regression.frozen(made)
    saved = spark.createDataFrame(raws, "case_id string, raw string")
    finished = finished_of(saw or made, saved)
    return {r.case_id: r for r in regression.abstention_checks(before, finished, MARKER, MESSAGE, sources()).collect()}


def test_each_check_fails_on_its_own(spark, made):
    found = run(spark, made, [("a", MARKER), ("b", f" {MARKER}\n"), ("c", f"{MARKER} yet"), ("d", "See [1]"), ("empty", MARKER), ("new", MARKER)])
    failing = lambda c: {x for x in regression.CHECKS if not found[c][x]}
    assert failing("a") == failing("b") == failing("empty") == set() and found["a"].passed
    assert failing("c") == {"marker_only"}
    assert failing("d") == {"marker_only", "message_exact", "no_inline_sources"}
    assert failing("e") == set(regression.CHECKS) and not found["e"].passed
    assert "new" not in found  # a saved answer without its case can't be finished


def test_changed_evidence_is_seen(spark, made):
    turned = made.withColumn("evidence", F.when(F.col("case_id") == "a", F.reverse("evidence")).when(F.col("case_id") == "b", F.slice("evidence", 1, 1)).otherwise(F.col("evidence")))
    more = turned.unionByName(made.where("case_id = 'a'").withColumn("case_id", F.lit("z")))
    found = run(spark, made, [(c, MARKER) for c in "abcdez"] + [("empty", None)], more)
    assert not found["a"].evidence_same and not found["a"].sources_same and found["a"].count_same
    assert not found["b"].count_same and found["c"].passed
    assert not found["z"].in_both and not found["z"].passed
    assert not found["empty"].passed and found["empty"].in_both


def test_report_counts_and_names(spark, made):
    before = regression.frozen(made)
    finished = finished_of(made, spark.createDataFrame([("a", MARKER), ("b", "See [1]")], "case_id string, raw string"))
    checks = regression.abstention_checks(before, finished, MARKER, MESSAGE, sources())
    report = {r.check: (r.n_cases, r.n_failed, r.first_failed) for r in regression.check_report(checks).collect()}
    assert report["in_both"] == (6, 4, "c") and report["message_exact"] == (6, 5, "b") and report["passed"] == (6, 5, "b")
    assert {r.n_failed for r in regression.check_report(checks.where("false")).collect()} == {0}


def test_frozen_cases_are_written_once(spark, made, tmp_path):
    folder = str(tmp_path / "run")
    assert regression.freeze(made, folder).count() == 6
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        regression.freeze(made, folder)
    for bad in (made.unionByName(made.where("case_id = 'a'")), made.withColumn("case_id", F.when(F.col("case_id") != "a", F.col("case_id")))):
        with pytest.raises(ValueError, match="null or repeated"):
            regression.freeze(bad, str(tmp_path / "other"))


def test_reservations_are_exact(spark):
    calls = spark.createDataFrame([(1, "é" * 100), (2, None), (3, "x" * 488)], "id int, text string")
    rows = regression.reserved_within(regression.reservations(calls, F.col("text"), 1000, "0.05", "0.40"), [F.col("id")], "0.0008612").orderBy("id").collect()
    assert [r.input_bound for r in rows] == [712, 512, 1000]
    assert [str(r.reserved) for r in rows] == ["0.0004356000", "0.0004256000", "0.0004500000"]
    assert [r.in_budget for r in rows] == [True, True, False]  # the second meets the budget to the last place


def test_reviewed_cases_alone(spark):
    issue = "array<struct<repository: string, issue_number: bigint, issue_url: string>>"
    cases = spark.createDataFrame(
        [("a", [("r", 1, None)], "manually_verified", False), ("b", [("s", 2, None)], "manually_verified", False), ("c", [], "manually_verified", None), ("d", [("r", 3, None)], "heuristic", False)],
        f"case_id string, expected_issues {issue}, verification_status string, expected_abstain boolean",
    )
    metrics = spark.createDataFrame([("a", True, 1, 1.0, 0.5), ("b", True, 0, 0.0, 0.0), ("c", True, 1, 1.0, 1.0), ("d", True, 1, 1.0, 1.0)], "case_id string, applicable boolean, hit int, recall double, mrr double")
    best = spark.createDataFrame([("a", 0.9), ("c", 0.1)], "case_id string, score double")
    rows = {r.repository: (r.n_cases, r.n_hits, r.n_refused, r.mrr) for r in regression.reviewed_scores(cases, metrics, best, 0.5).collect()}
    assert rows == {None: (3, 2, 2, 0.5), "r": (1, 1, 0, 0.5), "s": (1, 0, 1, 0.0)}
    assert regression.require_reviewed(cases.where("case_id <> 'd'"), 3).count() == 3
    for n, some in ((3, cases), (4, cases), (2, cases.where("case_id <> 'd'"))):
        with pytest.raises(ValueError, match="reviewed"):
            regression.require_reviewed(some, n)
