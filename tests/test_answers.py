import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from strandspark.operators import answers
from strandspark.sources.paged import PagedJson


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_cleaning_keeps_supported_code(spark):
    answer = "Use this:\n```py\nx  = 1\n```\n- \n1. \n\n\n\nNot this:\n~~~\nrm -rf\n~~~\nend  \n```\nopen"
    got = one(spark, answers.cleaned(F.col("a"), F.col("e")), a=answer, e=["before x = 1 after"])
    assert got == "Use this:\n```py\nx  = 1\n```\n\nNot this:\nend\nopen"
    assert one(spark, answers.cleaned(F.col("a"), F.col("e")), a="```\nx\n```", e=["y"]) == answers.NO_USABLE_ANSWER


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("a\n````\nx = 1\n```\nmore\n````\nb", "a\nb"),  # three marks don't close a block of four
        ("a\n````\nx = 1\n```\nb", "a\nx = 1\nb"),  # neither where no four follow: the first fence is open, and the second
        ("a\n```\nx = 1\n```~~~\ny\n```\nb", "a\nb"),  # other marks behind it: no closing fence
        ("a\n```\nx = 1\n`````  \nb", "a\n```\nx = 1\n`````  \nb"),  # more marks close
        ("a\n```\nx = 1\n~~~\nb", "a\nx = 1\nb"),
        ("a\n~~~ py\nx = 1\n~~~ \nb\n", "a\n~~~ py\nx = 1\n~~~ \nb"),
        ("- [ ] \n2) \n+ text  \n", "+ text"),
    ],
)
def test_fences_close_with_their_own_marks(spark, answer, want):
    assert one(spark, answers.cleaned(F.col("a"), F.col("e")), a=answer, e=["so x = 1 it is"]) == want


def test_unsafe_blocks_whatever_follows_their_fence(spark):
    block = "see\n```py\nreturn settings.config\n``` see above\nrest"
    assert one(spark, answers.safe_excerpt(F.col("a")), a=block) == f"see\n{answers.OMITTED_EXAMPLE} see above\nrest"
    assert json.loads(one(spark, answers.safe_payload(F.col("a")), a=json.dumps({"x": [{"excerpt": block}]})))["x"][0]["excerpt"] == f"see\n{answers.OMITTED_EXAMPLE} see above\nrest"
    harmless = "see\n```py\nx = 1\n``` see above"
    assert one(spark, answers.safe_excerpt(F.col("a")), a=harmless) == harmless


def test_finalisation_order(spark):
    last = answers.finalized(F.col("a"), F.col("e"), "[NONE]", "no answer")
    cases = {"[NONE] because": "no answer", "**I cannot answer** that": "no answer", "return settings.config": answers.UNSAFE_SETTINGS_ANSWER, "It is 5. We cannot answer more.": "It is 5. We cannot answer more.", "key sk-abcdefghijklmnop1234": "key [REDACTED]"}
    for a, want in cases.items():
        assert one(spark, last, a=a, e=["x"]) == want
    assert answers.OMITTED_EXAMPLE in one(spark, answers.safe_excerpt(F.col("a")), a="see\n```\nreturn settings.config\n```\n")


@pytest.mark.parametrize("lengths, fixed, limit, want", [([10, 20, 30], 5, 65, 30), ([10, 20, 30], 5, 55, 20), ([10, 20, 30], 5, 35, 10), ([10, 20, 30], 5, 20, 5), ([10], 30, 20, None), ([4, 9], 0, 12, 8)])
def test_prompt_room(spark, lengths, fixed, limit, want):
    assert one(spark, answers.common_length(F.col("n"), F.col("f"), limit), n=lengths, f=fixed) == want


def test_generation_metrics(spark):
    got = lambda a, chunks, abstain=False: tuple(one(spark, answers.generation_metrics(F.col("a"), F.col("c"), F.lit(abstain)), a=a, c=chunks))
    assert got("The parser reads config files [1].", ["parser config reader"]) == (False, True, True, True)
    assert got("The parser reads config files [2].", ["parser config reader"]) == (False, True, False, False)
    assert got("The parser reads config files.", ["parser config reader"]) == (False, True, False, False)
    assert got("There is insufficient evidence.", ["x"], True) == (True, True, True, True)
    assert got("Completely unrelated statement here [1].", ["parser config reader"]) == (False, True, True, False)


def test_paged_source(spark):
    failed = []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if "page=2" in self.path and not failed:
                failed.append(1)
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            self.send_response(200)
            if "page=2" not in self.path:
                self.send_header("Link", f'<http://{self.headers["Host"]}/x?page=2>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps([{"n": 1}, {"n": 2}] if "page=2" not in self.path else [{"n": 3}]).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"127.0.0.1:{server.server_port}"
    spark.dataSource.register(PagedJson)
    df = spark.read.format("paged_json").option("urls", f"http://{host}/x").option("hosts", host).load()
    assert [(r.page, r.position, json.loads(r.json)["n"]) for r in df.orderBy("page", "position").collect()] == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]
    with pytest.raises(Exception, match="allowed"):
        spark.read.format("paged_json").option("urls", "http://elsewhere/x").option("hosts", host).load().collect()
    server.shutdown()
