"""The paged source as a stream, nested pages, scan limits and observed counts against a small local service."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from strandspark.sources import paged

ITEMS = [{"n": n, "updated_at": f"2024-01-{n:02d}T00:00:00Z", **({"pull_request": {}} if n % 4 == 0 else {})} for n in range(1, 13)]


@pytest.fixture
def service():
    seen, held = [], {"a": list(ITEMS), "b": ITEMS[:3]}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            query = {k: v[0] for k, v in parse_qs(url.query).items()}
            seen.append((url.path, query))
            host, name, page = self.headers["Host"], url.path.strip("/"), int(query.get("page", 1))
            if name.startswith("comments"):
                items = [{"c": f"{name}-{i}"} for i in range(int(name.split("-")[1]) % 4)]
            else:
                items = [{**x, "comments_url": f"http://{host}/comments-{x['n']}"} for x in held[name] if x["updated_at"] >= query.get("since", "")]
            self.send_response(200)
            if len(items) > 2 * page:
                since = f"&since={query['since']}" if "since" in query else ""
                self.send_header("Link", f'<http://{host}{url.path}?page={page + 1}{since}>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps(items[2 * page - 2 : 2 * page]).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}", seen, held
    server.shutdown()


def _numbers(rows):
    return sorted(json.loads(r.json)["n"] for r in rows)


def test_a_restart_asks_from_the_committed_offset(spark, service, tmp_path):
    host, seen, held = service
    spark.dataSource.register(paged.PagedJson)
    counters = paged.Counters("landed")
    spark.streams.addListener(counters)

    def run(urls, until):
        rows = spark.readStream.format("paged_json").options(urls=",".join(f"http://{host}/{u}" for u in urls), hosts=host, since="2024-01-02T00:00:00Z", until=until, without="pull_request").load()
        rows = rows.observe("landed", F.count(F.lit(1)).alias("n"))
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.read.parquet(f"{tmp_path}/out").collect()

    try:
        assert _numbers(run("a", "2024-01-07T00:00:00Z")) == [2, 3, 5, 6]
        before = len(seen)
        rows = run("a", "2024-01-07T00:00:00Z")  # nothing new
        assert len(seen) == before and len(rows) == 4
        held["a"][1] = {**ITEMS[1], "updated_at": "2024-01-09T12:00:00Z"}  # changed after it was read: it comes again
        assert _numbers(run("a", "2024-01-10T00:00:00Z")) == [2, 2, 3, 5, 6, 7, 9]
        assert {q["since"] for _, q in seen[before:] if "page" not in q} == {"2024-01-07T00:00:00Z"}
        before = len(seen)
        rows = run("ab", "2024-01-11T00:00:00Z")  # an address more: read from the first time on
        assert {(p, q.get("since")) for p, q in seen[before:] if "page" not in q} == {("/a", "2024-01-10T00:00:00Z"), ("/b", "2024-01-02T00:00:00Z")}
        assert _numbers(r for r in rows if r.url.endswith("/b")) == [2, 3] and len(rows) == 10
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert sum(m["n"] for _, m in counters.batches) == len(rows)
    finally:
        spark.streams.removeListener(counters)


def test_limits_count_what_is_skipped_and_counts_equal_a_recount(spark, service):
    host, seen, _ = service
    options = {"urls": f"http://{host}/a,http://{host}/b", "hosts": host, "without": "pull_request"}
    kept, counts = paged.fetched(spark, options, lambda rows: rows.where("position = 0"))
    got = {urlsplit(r.url).path: tuple(r)[1:] for r in counts.collect()}
    assert got == {"/a": (6, 12, 3, 9, 6), "/b": (2, 3, 0, 3, 2)}
    assert kept.count() == 8 and len(seen) == 8  # each page was fetched once
    for limit, want in (({"most_seen": "5"}, [1, 2, 3, 5]), ({"most": "4"}, [1, 2, 3, 5]), ({"most_seen": "4"}, [1, 2, 3]), ({"most": "0"}, []), ({"most": "3", "most_seen": "2"}, [1, 2])):
        rows, one = paged.fetched(spark, {**options, "urls": f"http://{host}/a", **limit})
        assert _numbers(rows.collect()) == want
        assert "most_seen" not in limit or one.first().seen <= int(limit["most_seen"])


def test_all_comment_pages_of_each_element(spark, service):
    host, seen, _ = service
    rows, _ = paged.fetched(spark, {"urls": f"http://{host}/b", "hosts": host})
    nested = {json.loads(r.json)["issue"]["n"]: json.loads(r.json)["comments"] for r in paged.with_nested(rows, {"hosts": host}).collect()}
    assert nested == {n: [{"c": f"comments-{n}-{i}"} for i in range(n)] for n in (1, 2, 3)}
    assert sum(p == "/comments-3" for p, _ in seen) == 2
    with pytest.raises(Exception, match="isn't allowed"):
        paged.with_nested(rows, {"hosts": "elsewhere"}).collect()
    with pytest.raises(Exception, match="has no nowhere_url"):
        paged.with_nested(rows, {"hosts": host}, field="nowhere_url").collect()
