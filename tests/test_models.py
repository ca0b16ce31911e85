"""Model plug-ins with small stand-ins, prompts, payloads, and web-search matching against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strandspark.operators import answers, chunking, fulltext, models


def test_embeddings_keep_their_order(spark):
    def factory():
        made, calls = models.HashEmbedder(8), [0]

        def model(texts):
            assert len(texts) <= 3
            calls[0] += 1
            if calls[0] == 1:
                raise models.Retry("busy")
            return made(texts)[::-1]

        return model

    rows = spark.createDataFrame([(i, f"text {i % 4}") for i in range(10)] + [(10, None)], "id long, text string")
    got = {r.id: r.embedding for r in models.embedded(rows, factory, 8, batch=3, most_wait=0).collect()}
    assert got == {i: pytest.approx(models.HashEmbedder(8)([f"text {i % 4}" if i < 10 else ""])[0][1]) for i in range(11)}
    with pytest.raises(Exception, match="doesn't have 9 dimensions"):
        models.embedded(rows, lambda: models.HashEmbedder(8), 9).collect()
    with pytest.raises(Exception, match="texts were sent"):
        models.embedded(rows, lambda: lambda texts: models.HashEmbedder(8)(texts)[:-1], 8).collect()
    cached = spark.createDataFrame([("a", "q", [1.0]), ("b", "old", [2.0])], "case_id string, question string, embedding array<double>")
    cases = spark.createDataFrame([("a", "q"), ("b", "new"), ("c", "q")], "case_id string, question string")
    assert {r.case_id: r.embedding for r in models.reused_embeddings(cases, cached).collect()} == {"a": [1.0], "b": None, "c": None}


def test_contracts_of_replies(spark):
    replies = {"a": '{"label": "bug", "confidence": "high", "rationale": " why "}', "b": '{"label": "else", "confidence": "high", "rationale": "x"}', "c": "no json", "d": '{"label": "usage", "confidence": "low", "rationale": " "}'}
    threads = spark.createDataFrame([(i, t, None) for i, t in enumerate(replies)], "id long, title string, body string")
    good, bad = models.classified(threads, lambda: lambda request: replies[json.loads(request)["title"]])
    assert [tuple(r) for r in good.collect()] == [(0, "bug", "high", "why")] and {r.id for r in bad.collect()} == {1, 2, 3}
    results = spark.createDataFrame([("c1", "q", "a", ["s"], "heuristic")], "case_id string, question string, answer string, citations array<string>, verification_status string")
    judged = models.judged(results, lambda: lambda request: json.dumps({"grounded": "q" in request, "citation_support": False, "brief_reason": "r"})).first()
    assert (judged.label, judged.grounded, judged.citation_support, judged.abstention_appropriate) == (models.ESTIMATE, True, False, None)
    rows = spark.createDataFrame([(1, "t", "b" * 9000, [("x",)] * 9), (2, "t", "same", []), (3, "t", "same", []), (4, "blank", "", [])], "id long, title string, body string, comments array<struct<body: string>>")

    def draft(request):
        x = json.loads(request)
        assert len(x["body"]) <= 5000 and len(x["comments"]) <= 4
        return " \n" if x["title"] == "blank" else f" how \n of {x['body'][:4]}?"

    good, bad = models.drafted(rows, lambda: draft)
    assert {(r.id, r.question) for r in good.collect()} == {(1, "how of bbbb?"), (2, "how of same?")} and {r.id for r in bad.collect()} == {3, 4}


def test_prompts_fit_their_limit(spark):
    rng = random.Random(2)
    template = "Answer from {retrieved_chunks}."
    encode, _ = chunking.words()
    rows = [(i, f"question {i}", [json.dumps({"citation": f"[{k}]", "excerpt": " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60)))}) for k in range(rng.randrange(0, 5))]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, question string, evidence array<string>")
    for limit in (0, 20, 60, 100_000):
        got = {r.id: r for r in answers.prompts(df, limit, template, chunking.words, reserve=3).collect()}
        for i, question, evidence in rows:
            items = [json.loads(e) for e in evidence]

            def whole(size):
                shown = items if size is None else [{**x, "excerpt": x["excerpt"][:size], "excerpt_truncated": len(x["excerpt"]) > size} for x in items]  # noqa: B023
                return [{"role": "system", "content": template.replace("{retrieved_chunks}", json.dumps(shown, ensure_ascii=False))}, {"role": "user", "content": question}]  # noqa: B023

            count = lambda size: 3 + sum(len(encode(t)) for m in whole(size) for t in m.values())  # noqa: E731, B023
            fits = [n for n in range(max((len(x["excerpt"]) for x in items), default=0) + 1) if count(n) <= limit]
            want = whole(None) if count(None) <= limit else whole(max(fits)) if fits else None
            assert (json.loads(got[i].messages) if got[i].messages else None) == want
            assert got[i].truncated == (count(None) > limit)


def test_payloads(spark):
    code = "```py\nreturn settings.config\n```\n"
    payload = {"answer": "use password = 'x1'", "n": 3, "deep": [{"excerpt": "Bearer abc", "title": "Bearer abc", "chunk_text": code}], "other": {"answer": "return settings.config"}}
    got = json.loads(spark.createDataFrame([(json.dumps(payload),), (None,)], "p string").select(answers.safe_payload("p").alias("x")).first().x)
    assert got["answer"] == "use password = '[REDACTED]'" and got["deep"][0]["excerpt"] == "Bearer [REDACTED]" and got["deep"][0]["title"] == "Bearer abc"
    assert got["deep"][0]["chunk_text"].strip() == answers.OMITTED_EXAMPLE and got["other"]["answer"] == answers.UNSAFE_SETTINGS_ANSWER and got["n"] == 3
    assert spark.createDataFrame([(" a  b\nc ",)], "t string").select(answers.or_query(F.col("t"))).first()[0] == "a OR b OR c"


def test_web_queries(spark):
    docs = {1: "red fox jumps", 2: "fox red", 3: "the red quick fox sleeps", 4: "blue whale", 5: "", 6: "red red fox blue"}
    queries = {1: "red fox", 2: '"red fox"', 3: "whale OR fox", 4: "fox -blue", 5: '"red fox" or whale', 6: "-red", 7: "the of", 8: 'red -"red fox"', 9: "sleeps whale", 10: None}
    want = {1: {1, 2, 3, 6}, 2: {1, 6}, 3: {1, 2, 3, 4, 6}, 4: {1, 2, 3}, 5: {1, 4, 6}, 8: {2, 3}}
    got = {}
    for r in fulltext.web_match(spark.createDataFrame(list(docs.items()), "id long, text string"), spark.createDataFrame(list(queries.items()), "query_id long, text string")).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == want


def test_gold_ranks(spark):
    docs = {1: "fox and hound", 2: "fox", 3: "hound fox hound", 4: "cat"}
    queries = spark.createDataFrame([(1, "fox hound"), (2, "cat"), (3, "zebra")], "query_id long, text string")
    gold = spark.createDataFrame([(1, 2), (1, 1), (2, 3)], "query_id long, id long")
    got = {(r.query_id, r["mode"]): (r.n_candidates, r.gold_rank) for r in fulltext.gold_ranks(spark.createDataFrame(list(docs.items()), "id long, text string"), queries, gold).collect()}
    assert got[1, "strict"] == got[1, "web"] == (2, 2) and got[1, "loose"][0] == 3 and got[1, "loose"][1] in (1, 2, 3)
    assert got[2, "strict"] == (1, None) and got[3, "loose"] == (0, None) and re.match("w", "web")
