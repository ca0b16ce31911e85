"""Cases, gold matches and summaries against plain Python."""

import json
import random
from collections import defaultdict

import pytest

from strandspark.operators import cases
from strandspark.operators.ordering import cumulated, global_rank, percentiles
from pyspark.sql import functions as F

BASE = {"case_id": "c", "question": "q", "expected_issues": [], "expected_issue_urls": [], "verification_status": "heuristic", "expected_abstain": False, "verification_note": ""}


def test_validation(spark):
    made = [
        ({**BASE, "case_id": "a"}, None), ({**BASE, "case_id": "a"}, "invalid or duplicate case_id"), ({**BASE, "case_id": ""}, "invalid or duplicate case_id"), ({**BASE, "case_id": 3}, "invalid or duplicate case_id"), ({k: v for k, v in BASE.items() if k != "question"}, "missing fields"),
        ({**BASE, "case_id": "b", "verification_status": "other"}, "invalid verification status"), ({**BASE, "case_id": "d", "question": " "}, "question is empty"), ({**BASE, "case_id": "e", "expected_issues": {}}, "expected sources must be lists"),
        ({**BASE, "case_id": "f", "verification_status": "unresolved", "expected_issue_urls": ["u"]}, "unresolved cases have no expected issue"), ({**BASE, "case_id": "g", "verification_status": "unresolved", "extra": 1}, None), ("bad", "invalid JSON"), ([1], "missing fields"),
        ({**BASE, "case_id": "h", "expected_issues": [{"repository": "r", "issue_number": 4}]}, None),
    ]
    rows = [(i, "{" if x == "bad" else json.dumps(x)) for i, (x, _) in enumerate(made, 1)]
    good, bad = cases.validated_cases(spark.createDataFrame(rows, "line long, json string"))
    assert {r.line: r.reason for r in bad.collect()} == {i: reason for i, (_, reason) in enumerate(made, 1) if reason}
    held = {r.case_id: r for r in good.collect()}
    assert set(held) == {"a", "g", "h"} and held["h"].expected_issues[0].issue_number == 4
    with pytest.raises(ValueError, match="line 2: invalid or duplicate"):
        cases.require_cases(good, bad)
    assert cases.require_cases(good, bad.where("false")).count() == 3


def test_metrics_and_summaries(spark):
    rng = random.Random(3)
    source = lambda: {"repository": rng.choice("rst"), "issue_number": rng.randrange(4), "issue_url": rng.choice([None, "", f"u{rng.randrange(6)}"])}
    made, results = [], []
    for i in range(80):
        issues = [source() for _ in range(rng.randrange(3))]
        made.append({**BASE, "case_id": f"c{i}", "expected_issues": issues, "expected_issue_urls": [f"u{rng.randrange(6)}" for _ in range(rng.randrange(2))], "verification_status": rng.choice(["heuristic", "manually_verified"])})
        results += [(f"c{i}", rank, rng.choice("rst"), rng.randrange(4), f"u{rng.randrange(6)}") for rank in range(1, rng.randrange(2, 7))]
    want = {}
    for c in made:
        expected = c["expected_issues"] or [{"issue_url": u} for u in c["expected_issue_urls"]]
        first, keys = None, set()
        for _, rank, repo, number, url in sorted(r for r in results if r[0] == c["case_id"]):
            hit = next((e for e in expected if ("repository" in e and (e["repository"], e["issue_number"]) == (repo, number)) or (e["issue_url"] and e["issue_url"] == url)), None)
            if hit:
                keys.add(hit["issue_url"] or (hit["repository"], hit["issue_number"]))
                first = first or rank
        want[c["case_id"]] = (int(first is not None), len(keys) / len(expected), 1 / first if first else 0.0) if expected else (None, None, None)
    good, bad = cases.validated_cases(spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(made)], "line long, json string"))
    found = cases.retrieval_metrics(good, spark.createDataFrame(results, "case_id string, rank int, repository string, issue_number long, issue_url string"))
    assert {r.case_id: (r.hit, r.recall, r.mrr) for r in found.collect()} == {k: tuple(pytest.approx(x) if x is not None else None for x in v) for k, v in want.items()}
    groups = defaultdict(list)
    for c in made:
        if want[c["case_id"]][0] is not None:
            for g in {("all", None), ("status", c["verification_status"]), *(("repository", e["repository"]) for e in c["expected_issues"])}:
                groups[g].append(want[c["case_id"]])
    got = {(r.grouping, r.name): (r.n_cases, r.hit, r.recall, r.mrr) for r in cases.retrieval_summary(good, found).collect()}
    assert got == {g: (len(x), *(pytest.approx(sum(c) / len(x)) for c in zip(*x))) for g, x in groups.items()}
    assert cases.changed_metrics(found, found).count() == 0
    both = cases.compared({"a": spark.createDataFrame(results, "case_id string, rank int, repository string, issue_number long, issue_url string"), "b": spark.createDataFrame([], "case_id string, rank int, repository string, issue_number long, issue_url string")}, good)
    assert {r["mode"] for r in both.collect()} == {"a", "b"}


def test_cutoffs_samples_and_budgets(spark):
    scores = spark.createDataFrame([(True, 0.9), (True, 0.1), (False, None), (False, 0.6)], "answerable boolean, score double")
    assert {(r.answerable, r.refused): r.n for r in cases.cutoff_confusion(scores, 0.5).collect()} == {(True, False): 1, (True, True): 1, (False, True): 1, (False, False): 1}
    df = spark.range(40).selectExpr("id", "id % 4 AS g")
    picked = [sorted(r.id for r in cases.sampled(d, "g", 3, 5, "id").collect()) for d in (df, df.repartition(7))]
    assert picked[0] == picked[1] and len(picked[0]) == 12
    with pytest.raises(ValueError, match="10 of 11"):
        cases.sampled(df, "g", 11, 5, "id")
    a, b = ([r.id for r in cases.shuffled(df, seed, "id").orderBy("place").collect()] for seed in (1, 2))
    assert sorted(a) == sorted(b) == list(range(40)) and a != b
    got = cases.within_budget(df.where("id > 35"), df.where("id < 9"), 6, "id").collect()
    assert {r.id for r in got} == {36, 37, 38, 39, 0, 1}
    s = spark.sql("SELECT array('a', 'b', 'a') AS x, array('b', 'a') AS y, array('a') AS z")
    assert tuple(s.select(cases.same_scope(F.col("x"), F.col("y")), cases.same_scope(F.col("x"), F.col("z"))).first()) == (True, False)


def test_evaluation_sink(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 1), ("c2", 0)], "case_id string, hit int")
    cases.write_evaluation({"top_k": "5"}, rows, str(tmp_path), "r1")
    rows.selectExpr("'r2' AS run_id", "*").write.mode("append").parquet(f"{tmp_path}/cases")  # a run that failed before its header
    assert sorted((r.run_id, r.case_id) for r in cases.read_evaluations(spark, str(tmp_path)).collect()) == [("r1", "c1"), ("r1", "c2")]


def test_running_sums_by_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, rng.randrange(5), float(rng.randrange(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, n long, v double")
    got = {r.id: r.before for r in cumulated(df, [F.col("v").desc(), F.col("id")], {"n": "before"}, ("g",)).collect()}
    want = {}
    for g in "ab":
        total = 0
        for _, i, n, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])):
            want[i], total = total, total + n
    assert got == want
    ranks = {r.id: r["rank"] for r in global_rank(df, [F.col("v"), F.col("id")]).collect()}
    assert ranks == {r[1]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[3], r[1])), 1)}
    import numpy as np

    for r in percentiles(df, "g", "v", {"p10": 0.1, "p95": 0.95}).collect():
        values = [x[3] for x in rows if x[0] == r.g]
        assert (r.n, r.p10, r.p95) == (len(values), pytest.approx(np.percentile(values, 10)), pytest.approx(np.percentile(values, 95)))
