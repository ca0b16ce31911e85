"""The paged source against a small local service."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from strandspark.operators import evaluation
from strandspark.sources import paged


@pytest.fixture(scope="module")
def service():
    seen, busy = [], {"left": 1}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            query = {k: v[0] for k, v in parse_qs(url.query).items()}
            seen.append((url.path, query, self.headers.get("Authorization")))
            if busy["left"]:
                busy["left"] -= 1
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            page = int(query.get("page", 1))
            items = [{"n": 10 * page + i, **({"pull_request": {}} if i == 1 else {})} for i in range(3)]
            self.send_response(200)
            if page < 3:
                self.send_header("Link", f'<http://{self.headers["Host"]}{url.path}?page={page + 1}>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps(items).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_pages_budgets_and_counts(spark, service):
    host, seen = service
    options = {"urls": f"http://{host}/a,http://{host}/b", "hosts": host, "token": "t", "without": "pull_request", "since": "2024-01-01T00:00:00Z", "most_wait": "0"}
    kept, counts = paged.fetched(spark, options, lambda rows: rows.where("page <> 2"))
    assert sorted((urlsplit(r.url).path, json.loads(r.json)["n"]) for r in kept.collect()) == [(p, n) for p in ("/a", "/b") for n in (10, 12, 30, 32)]
    assert {(r.pages, r.fetched, r.kept) for r in counts.collect()} == {(3, 6, 4)} and counts.count() == 2
    first = [q for _, q, _ in seen if "page" not in q]
    assert all(q["since"] == "2024-01-01T00:00:00Z" for q in first) and all(a == "Bearer t" for _, _, a in seen)
    before = len(seen)
    few, _ = paged.fetched(spark, {**options, "urls": f"http://{host}/a", "most": "3"})
    assert [json.loads(r.json)["n"] for r in few.orderBy("page", "position").collect()] == [10, 12, 20]
    assert max(int(q.get("page", 1)) for _, q, _ in seen[before:]) == 2
    with pytest.raises(Exception, match="isn't allowed"):
        paged.fetched(spark, {"urls": "http://elsewhere/x", "hosts": host})


def test_spending_and_performance(spark):
    calls = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i), 0.5, i == 3) for i in range(1, 7)], "id long, g string, ms double, cost double, refused boolean")
    assert [r.id for r in evaluation.within_spend(calls, [F.col("id")], "cost", 1.6).orderBy("id").collect()] == [1, 2, 3]
    got = {r.g: r for r in evaluation.performance_summary(calls, "g", "ms", "cost", "refused").collect()}
    assert (got["a"].n, got["a"].p50, got["a"].cost, got["a"].mean_cost, got["a"].n_refused) == (3, 3.0, 1.5, 0.5, 1) and got["b"].n_refused == 0
