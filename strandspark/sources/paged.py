"""A batch and streaming source for paged JSON services: a partition a start address, pages followed by their link headers."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlencode, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener

from ..staging import written

_NEXT = re.compile(r'<([^>]+)>\s*;\s*rel="?next"?')


class PagedJson(DataSource):
    """``format("paged_json")``: options urls (comma-separated), hosts (allowed), token, attempts, most_wait, since, without, most, most_seen, count_skipped.

    ``since`` is sent with each start address; elements with the key ``without`` are
    skipped; a start address gives at most ``most`` elements, and looks at no more than
    ``most_seen``, those included that it skips; no page is fetched
    beyond them. With ``count_skipped`` skipped elements are rows as well, marked by a column skipped.

    As a stream, each start address has an offset, the time up to which it has been read.
    A batch asks each address for what changed since its offset, and keeps the elements whose field
    ``cursor`` (updated_at) lies before the new offset: ``settle`` seconds before now, or
    ``until``. Windows are half open, so an element's change is in one batch, and a
    restarted stream asks from the committed offset and no earlier.

    Rows have url, page (from 1), position (from 0) and json, an element of the page's
    list each. Credentials go to allowed hosts only. A repeated task reads its pages
    again; a sink that upserts by key makes that harmless.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "url string, page int, position int, json string" + (", skipped boolean" if "count_skipped" in self.options else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def fetched(spark: SparkSession, options: dict[str, str], keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """The kept rows of a paged scan as a table, and counts by start address, taken while it is written: one scan and one job.

    ``keep`` drops what needn't land, such as objects that are there already. Counts are
    pages, seen (all elements), skipped, fetched (the others) and kept. They are observed
    metrics: exact unless a lost executor makes Spark run a shuffle of ``keep`` again.
    """
    spark.dataSource.register(PagedJson)
    urls, before, behind = _Reader(options).urls, Observation(), Observation()
    of = lambda i, also=True: F.count_if((F.col("url") == urls[i]) & also)
    rows = spark.read.format("paged_json").options(**options, count_skipped="true").load()
    seen = [x for i, u in enumerate(urls) for x in (of(i).alias(f"seen{i}"), of(i, F.col("skipped")).alias(f"skipped{i}"), F.max(F.when(F.col("url") == u, F.col("page"))).alias(f"pages{i}"))]
    kept = keep(rows.observe(before, F.count(F.lit(1)).alias("all"), *seen).where("NOT skipped").drop("skipped"))
    kept = written(kept.observe(behind, F.count(F.lit(1)).alias("all"), *[of(i).alias(f"kept{i}") for i in range(len(urls))]), "kept")
    a, b = before.get, behind.get
    counts = [(u, a[f"pages{i}"] or 0, a[f"seen{i}"], a[f"skipped{i}"], a[f"seen{i}"] - a[f"skipped{i}"], b[f"kept{i}"]) for i, u in enumerate(urls)]
    return kept, spark.createDataFrame(counts, "url string, pages int, seen long, skipped long, fetched long, kept long")


def with_nested(rows: DataFrame, options: dict[str, str], field: str = "comments_url", name: str = "comments", item: str = "issue") -> DataFrame:
    """Rows whose json holds the element under ``item`` and, under ``name``, all elements of all pages of the address in its ``field``.

    A task fetches its rows' addresses one after the other, by the same rules of hosts,
    attempts and waits; an element without an address is an error.
    """
    options = {**options, "urls": ""}

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(options)
        for frame in frames:
            out = []
            for text in frame.json:
                element = json.loads(text)
                if not isinstance(url := element.get(field), str):
                    raise ValueError(f"an element has no {field}: {text[:200]}")
                out.append(json.dumps({item: element, name: [x for _, _, x in reader.elements(url)]}))
            yield frame.assign(json=out)

    return rows.mapInPandas(fetch, rows.schema)


class Counters(StreamingQueryListener):
    """Observed metrics of a name, batch by batch, of the streams that run while it is added to the session."""

    def __init__(self, name: str):
        self.name, self.batches = name, []

    def onQueryProgress(self, event) -> None:
        if (row := event.progress.observedMetrics.get(self.name)) is not None:
            self.batches.append((event.progress.batchId, row.asDict()))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options["urls"].split(",") if u]
        self.hosts = set(options["hosts"].split(","))
        self.token = options.get("token")
        self.attempts, self.most_wait = int(options.get("attempts", 5)), float(options.get("most_wait", 60))
        self.without, self.counting = options.get("without"), "count_skipped" in options
        self.most, self.most_seen = (int(options[c]) if c in options else None for c in ("most", "most_seen"))
        if since := options.get("since"):
            self.urls = [_asked(u, since) for u in self.urls]
        for url in self.urls:
            self._allowed(url)

    def _allowed(self, url: str) -> None:
        if urlsplit(url).netloc not in self.hosts:
            raise ValueError(f"the host of {url} isn't allowed")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def _fetch(self, url: str) -> tuple[list, str | None]:
        self._allowed(url)
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                    link = _NEXT.search(answer.headers.get("Link") or "")
                    return json.load(answer), link and link[1]
            except urllib.error.HTTPError as e:
                if e.code not in (403, 429, 500, 502, 503, 504) or attempt == self.attempts - 1:
                    raise
                asked = e.headers.get("Retry-After")
                time.sleep(min(self.most_wait, float(asked) if asked and asked.isdigit() else 2.0**attempt))
        raise RuntimeError("no attempt was made")

    def elements(self, url: str) -> Iterator[tuple[int, int, object]]:
        """Page, position and element, of all pages from an address on."""
        page, following = 1, url
        while following:
            items, following = self._fetch(following)
            if not isinstance(items, list):
                raise ValueError(f"{url} gave no list")
            for i, item in enumerate(items):
                yield page, i, item
            page += 1

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        left, seen = self.most, 0
        if left == 0 or self.most_seen == 0:
            return
        for page, i, item in self.elements(partition.value):
            seen += 1
            skipped = bool(self.without) and isinstance(item, dict) and self.without in item
            if not skipped or self.counting:
                yield partition.value, page, i, json.dumps(item), *([skipped] if self.counting else [])
            left = left if left is None or skipped else left - 1
            if left == 0 or seen == self.most_seen:
                return


def _asked(url: str, since: str) -> str:
    return f"{url}{'&' if '?' in url else '?'}{urlencode({'since': since})}"


class _Window(InputPartition):
    def __init__(self, url: str, since: str | None, until: str):
        super().__init__((url, since, until))


class _StreamReader(DataSourceStreamReader):
    """Offsets are the times up to which each start address has been read, as UTC to the second."""

    def __init__(self, options: dict[str, str]):
        self.first, self.until, self.settle = options.pop("since", None), options.pop("until", None), float(options.pop("settle", 60))
        self.cursor, self.options = options.pop("cursor", "updated_at"), options
        self.reader = _Reader(options)

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.reader.urls, self.first)

    def latestOffset(self) -> dict:
        now = datetime.fromtimestamp(time.time() - self.settle, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return dict.fromkeys(self.reader.urls, self.until or now)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """An address that the stream's offsets don't know yet is read from the first time on."""
        windows = [_Window(u, start.get(u, self.first), until) for u, until in end.items()]
        return [w for w in windows if w.value[1] is None or w.value[1] < w.value[2]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, since, until = partition.value
        for page, i, item in self.reader.elements(_asked(url, since) if since else url):
            at = item.get(self.cursor) if isinstance(item, dict) else None
            if not isinstance(at, str):
                raise ValueError(f"an element of {url} has no {self.cursor}")
            skipped = bool(self.reader.without) and self.reader.without in item
            if at < until and (since is None or at >= since) and (not skipped or self.reader.counting):
                yield url, page, i, json.dumps(item), *([skipped] if self.reader.counting else [])

    def commit(self, end: dict) -> None:
        pass
