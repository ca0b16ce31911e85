"""Runs from raw objects to embedded chunks: what changed, replays, gates."""

import json

import pytest

from strandspark.operators import models, tables
from strandspark.streaming import layers


def _object(repo, n, at, body="It fails.", comments=(), url=None):
    issue = {"number": n, "html_url": url or f"https://github.com/{repo}/issues/{n}", "title": f"Title {n}", "body": body, "created_at": "2024-01-01T00:00:00Z", "updated_at": at, "closed_at": at, "user": {"login": "u"}, "author_association": "NONE", "labels": [{"name": "bug"}]}
    said = [{"id": i, "body": c, "created_at": "2024-01-01T10:00:00Z", "user": {"login": "m"}, "author_association": "MEMBER", "html_url": f"https://github.com/{repo}/issues/{n}#c{i}"} for i, c in enumerate(comments)]
    return repo, json.dumps({"issue": issue, "comments": said})


@pytest.fixture
def run(spark):
    for name in ("l_silver", "l_gold", "l_marks"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    silver, gold = tables.KeyedTable(spark, "l_silver", layers.THREAD, by=("repository",)), tables.KeyedTable(spark, "l_gold", layers.CHUNK, by=("repository",))
    marks = tables.KeyedTable(spark, "l_marks", ("key",), 2)

    def once(objects, dimensions=8, factory=lambda: models.HashEmbedder(8)):
        raw = spark.createDataFrame([(r, i, j) for i, (r, j) in enumerate(objects)], "repository string, seq long, json string")
        return layers.run_layers(raw, silver, gold, marks, factory, dimensions)

    once.gold, once.silver = gold, silver
    once.marks = lambda: {r.key: str(r.watermark)[:10] for r in marks.read().collect()}
    once.chunks = lambda: {(r.repository, r.issue_number, r.chunk_type, r.chunk_index): (r.chunk_text, tuple(r.embedding)) for r in gold.read().collect()}
    yield once
    for name in ("l_silver", "l_gold", "l_marks"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_changed_threads_alone_are_chunked_and_embedded(run):
    first = [_object("a/x", 1, "2024-02-01T00:00:00Z", comments=["one", "two"]), _object("a/x", 2, "2024-02-02T00:00:00Z"), _object("b/y", 1, "2024-02-03T00:00:00Z"), ("b/y", json.dumps({"issue": {}})), ("b/y", '{"no": 1}')]
    assert run(first) == {"rejected": 2, "stored": 3, "chunked": 3, "embedded": run.gold.read().count()}
    assert run.marks() == {"a/x": "2024-02-02", "b/y": "2024-02-03"}
    before = run.chunks()
    assert {k[:2] for k in before} == {("a/x", 1), ("a/x", 2), ("b/y", 1)}
    assert run(first) == {"rejected": 2, "stored": 3, "chunked": 0, "embedded": 0} and run.chunks() == before  # a replay
    got = run([_object("a/x", 1, "2024-03-01T00:00:00Z", comments=["one"]), _object("a/x", 3, "2024-03-02T00:00:00Z")])
    after = run.chunks()
    assert got["chunked"] == 2 and 0 < got["embedded"] < len(after)
    assert ("a/x", 1, "comment", 1) not in after and after["a/x", 1, "comment", 0] == before["a/x", 1, "comment", 0]
    assert {k: v for k, v in after.items() if k[:2] in {("a/x", 2), ("b/y", 1)}} == {k: v for k, v in before.items() if k[:2] in {("a/x", 2), ("b/y", 1)}}
    assert run.marks() == {"a/x": "2024-03-02", "b/y": "2024-02-03"}
    assert run([])["stored"] == 0


def test_a_failed_gate_or_model_leaves_chunks_and_watermarks(run):
    run([_object("a/x", 1, "2024-02-01T00:00:00Z")])
    before, marks = run.chunks(), run.marks()
    for objects, how in (([("a/x", "{broken")], {}), ([_object("a/x", 1, "2024-05-01T00:00:00Z", body="other")], {"dimensions": 9})):
        with pytest.raises(Exception, match="malformed|dimensions"):
            run(objects, **how)
        assert run.chunks() == before and run.marks() == marks
    assert run([_object("a/x", 1, "2024-05-01T00:00:00Z", body="other")])["chunked"] == 1  # the silver row was there, the chunks are made now
    assert run.chunks() != before and run.marks() == {"a/x": "2024-05-01"}
