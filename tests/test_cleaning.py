"""Cleaning rules in their order, labels, comments, times, and line numbers of raw files."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strandspark.operators import cleaning
from strandspark.sources import bronze

SCHEMA = "repository string, seq long, json string"


def raw(seq, comments=(), repository="a/b", **issue):
    base = {"number": seq, "html_url": f"https://github.com/a/b/issues/{seq}", "title": "T", "body": "B", "closed_at": "2024-02-01T00:00:00Z"}
    return repository, seq, json.dumps({"issue": {k: v for k, v in {**base, **issue}.items() if v != "absent"}, "comments": comments if comments == "x" else list(comments)})


def test_reasons_in_order(spark):
    ok = {"id": 1, "body": "hi", "created_at": "2024-01-01T00:00:00Z"}
    cases = [
        (raw(1), None), (raw(2, labels=None), None), (raw(3, title=5), "title and body must be text"), (raw(4, body=["x"]), "title and body must be text"), (raw(5, labels="bug"), "labels must be a list"),
        (raw(6, comments=[ok, 7]), "each comment must be an object"), (raw(7, comments=[{**ok, "body": 7}]), "text fields must be text"), (raw(8, comments=[{**ok, "created_at": 7}, "x"]), "timestamps must be text"),
        (raw(9, comments="x"), "comments must be a list"), (raw(10, closed_at=5, comments="x"), "timestamps must be text"), (raw(11, updated_at=5, title=5), "timestamps must be text"), (raw(12, html_url="http://github.com/x"), "a valid issue URL is required"),
        (raw(13, html_url="https://GITHUB.com/x"), None), (raw(14, html_url="https://github.com.evil/x"), "a valid issue URL is required"), (raw(15, html_url="absent"), "a valid issue URL is required"), (raw(16, number="absent"), "issue number must be an integer"),
        (raw(17, number="17"), None), (raw(18, number=1.5), "issue number must be an integer"), (raw(19, number=True), "issue number must be an integer"), (raw(20, number=-1), "issue number must be positive"), (raw(21, repository=" "), "repository is required"),
        (("a/b", 22, "nonsense"), "record must contain an object"), (("a/b", 23, '{"issue": 3}'), "issue is required"), (("a/b", 24, None), "record must contain an object"), (raw(25, closed_at=""), None), (raw(26, closed_at="2024"), None), (raw(27, title=None, body=None), None),
    ]
    good, bad = cleaning.clean_threads(spark.createDataFrame([c for c, _ in cases], SCHEMA))
    want = {c[1]: reason for c, reason in cases}
    assert {r.seq: r.reason for r in bad.collect()} == {s: x for s, x in want.items() if x}
    assert {r.seq for r in good.collect()} == {s for s, x in want.items() if not x}


def test_fields_of_a_clean_thread(spark):
    said = [
        {"id": 11, "body": " a &lt; b\r\n", "created_at": "2024-01-01T02:00:00+02:00", "author_association": "OWNER", "user": {"login": "x"}, "html_url": "u1"},
        {"id": "s", "body": None, "created_at": "2024-01-05T00:00:00.5Z", "author_association": "MEMBER", "user": 7},
        {"id": 13, "body": "late", "created_at": "2024-03-01T00:00:00Z", "author_association": "OWNER"}, {"id": 14, "body": "other", "created_at": "junk", "author_association": "NONE"},
    ]
    row = raw(5, comments=said, title=" Fix &amp;\n it\x1c ", body="\r\nx\ry\0 ", labels=[{"name": " big \n bug "}, "ui", " ", {"name": 3}, 7, None, {"other": 1}], user={"login": "me"}, author_association="NONE")
    good, bad = cleaning.clean_threads(spark.createDataFrame([row], SCHEMA))
    r = good.first()
    assert (r.title, r.body, r.labels, r.comment_count, r.author_login) == ("Fix & it", "x\ny", ["big bug", "ui"], 4, "me") and bad.count() == 0
    assert [(c.id, c.body, c.created_at, c.author_login, c.author_association, c.html_url) for c in r.comments] == [
        ("11", "a < b", "2024-01-01T00:00:00+00:00", "x", "OWNER", "u1"), ("s", None, "2024-01-05T00:00:00.500000+00:00", None, "MEMBER", None), ("13", "late", "2024-03-01T00:00:00+00:00", None, "OWNER", None), ("14", "other", None, None, "NONE", None),
    ]
    assert (r.resolution_text, r.resolution_heuristic, r.resolution_confidence) == (None, "unavailable_last_maintainer_comment_has_no_text", "none")
    assert r.author_associations == ["OWNER", "MEMBER", "NONE"]
    spoken = [{"body": "a < b", "html_url": "u1"}, {"body": "late", "html_url": None}, {"body": "other", "html_url": None}]
    fields = {"title": r.title, "body": r.body, "github_url": r.github_url, "comments": spoken, "resolution_text": None, "resolution_confidence": "none"}
    assert r.content_hash == hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_counters(spark):
    rows = spark.createDataFrame([raw(1), raw(9, number=1, title="again"), raw(2, body=""), raw(3, number="x"), raw(4, repository="c/d")], SCHEMA)
    found = {(r.repository, r.is_total): r for r in cleaning.validation_counters(rows, *cleaning.clean_threads(rows)).collect()}
    assert tuple(found["a/b", 0])[1:7] == (4, 2, 2, 1, 1, 2)
    assert found[None, 1].source_records == 5 and found["c/d", 0].valid_records == 1


def test_names_and_times(spark):
    x = spark.createDataFrame([("own.er/na-me_1",), ("a b/c",), ("a/b/c",), ("/x",)], "r string")
    assert [r[0] for r in x.select(cleaning.repository_name(F.col("r"))).collect()] == ["own.er/na-me_1", None, None, None]
    assert x.select(cleaning.path_safe(F.col("r"))).first()[0] == "own.er__na-me_1"
    t = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05' AS a, TIMESTAMP '2024-01-02 03:04:05.120' AS b")
    assert tuple(t.select(cleaning.iso(F.col("a"), "Z"), cleaning.iso(F.col("b"), "Z")).first()) == ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.120000Z")


@pytest.mark.parametrize("piece", ["64", "100m"])
def test_line_numbers(spark, tmp_path, piece):
    rng = random.Random(1)
    want = {}
    for name in ("a", "b"):
        lines = ["" if rng.random() < 0.1 else json.dumps({"issue": {"n": i}, "pad": "x" * rng.randrange(80)}) for i in range(120)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        want |= {(f"{name}.jsonl", i): x for i, x in enumerate(lines, 1) if x}
    (tmp_path / "c.json").write_text('{\n"issue": {}}\n')
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = bronze.read_objects(spark, str(tmp_path)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    got = {(r.path.rsplit("/", 1)[1], r.line): r.json for r in rows}
    assert len(rows) == len(want) + 1 and {k: v for k, v in got.items() if k[0] != "c.json"} == want and got["c.json", 1].startswith("{\n")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 'x "q", é\ny'), ("a", 2, "new"), ("b", 3, None)], "k string, at long, v string")
    bronze.write_objects(df, f"{tmp_path}/o", "k", ("k",), "at")
    assert sorted(r.v or "" for r in spark.read.json(f"{tmp_path}/o").collect()) == ["", "new"]
    bronze.write_review(df, f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith('"﻿k","at","v"') or text.startswith('﻿"k"') or text.startswith("﻿")
    bronze.write_manifest(spark.createDataFrame([("r1", 4, 1), ("r2", 5, 2)], "repository string, landed long, skipped int"), f"{tmp_path}/m", "run-1")
    rows = {r.repository: r for r in spark.read.json(f"{tmp_path}/m").collect()}
    assert rows[None].landed == 9 and rows[None].skipped == 3 and rows["r1"].run_id == "run-1"
    bronze.write_report(df, f"{tmp_path}/r", "Title")
    assert "| a | 1 |" in next((tmp_path / "r" / "markdown").glob("*.txt")).read_text()
    report = {r.check: r.value for r in bronze.bronze_report(spark.createDataFrame([('{"issue": {}}',), ("[1]",), ("bad",)], "json string")).collect()}
    assert report == {"records": 3, "empty": 0, "malformed": 1, "rejected": 1}
