"""Removal of repeated passages: Rabin-Karp hashes of every fixed-length word window.

A word goes if a window of ``width`` consecutive words that covers it also starts in
a document with a smaller id. All windows are hashed; what is shuffled is less:

1. Every window belongs to the run of its neighbours that share the same least hash
   of a 16-word gram in them. Equal windows have equal grams, so a run whose gram
   occurs in one document holds no repeated window. A run is one row: its gram, its
   place, its length, and one hash over all its windows.
2. Spark counts grams, then whole runs: a run that a smaller document has as well is
   repeated, window by window. The first document with a window never loses that
   window's run in this step, so the windows left to compare are in runs that are
   not yet repeated, of grams with such runs in several documents: passages' edges.
3. Those windows are hashed again, counted one by one, and marked.

Marked runs and windows merge into maximal intervals of words to remove. Grams and
windows are 64-bit hashes; runs and windows are compared together with their gram,
by 128 bits in all.

Edge cases: a null text has no words; a null doc_id counts as greater than all
others; rows under one doc_id are one document to each other, so nothing that only
they share is removed, and each row keeps its own text; texts shorter than a window
keep all words; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import powers, scrambled, sliding_min, window_hashes, word_hashes

WIDTH, GRAM = 50, 16
_LAST = 2**63 - 1
#: Documents that numpy handles at once.
_ROWS = 128
_RUN_BASE = 0xA0761D6478BD642F


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield batch.slice(k, _ROWS)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows that lie in one text: row, place of the first word, gram, hash."""
    hashes, counts = word_hashes(texts)
    windows = window_hashes(hashes, width)
    gram = min(GRAM, width)
    grams = sliding_min(window_hashes(hashes, gram, 1), width - gram + 1)[: len(windows)]
    row = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.flatnonzero(row[: len(windows)] == row[width - 1 :]) if len(windows) else np.empty(0, int)
    return row[inside], place[inside], grams[inside], windows[inside]


def _runs(width: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row, place, gram, window = _windows(_texts(part), width)
            if not len(row):
                continue
            first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])]))
            last = np.concatenate([first[1:], [len(row)]])
            up, down = powers(_RUN_BASE, len(row))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(window * up[: len(row)])])
            whole = scrambled((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
            take = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(take), part.column("th").take(take), pa.array(gram[first].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(place[first].astype(np.int32)), pa.array((last - first).astype(np.int32))],
                ["id", "th", "gram", "whole", "place", "n"],
            )

    return runs


def _edge_windows(width: int):
    """The windows of the runs listed in ``runs``."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row, place, gram, window = _windows(_texts(part), width)
            counts = np.bincount(row, minlength=part.num_rows)
            at = np.concatenate([[0], np.cumsum(counts)])
            wanted = np.zeros(len(row) + 1, np.int64)
            for k, runs in enumerate(part.column("runs").to_pylist()):
                for run in runs:
                    wanted[at[k] + run["place"]] += 1
                    wanted[at[k] + run["place"] + run["n"]] -= 1
            keep = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(take), part.column("th").take(take), pa.array(gram[keep].view(np.int64)), pa.array(window[keep].view(np.int64)), pa.array(place[keep].astype(np.int32))],
                ["id", "th", "gram", "whole", "place"],
            )

    return windows


def _without(width: int):
    """Merges each row's marks into intervals and cuts them out of its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            n_words, n_removed, digest, kept_text, spans = [], [], [], [], []
            for text, marks in zip(_texts(part), part.column("marks").to_pylist(), strict=True):
                words, merged = text.split(), []
                for a, b in sorted((m["place"], m["place"] + m["n"] + width - 1) for m in marks or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined if merged else text)
                spans.append([{"start": a, "end": b} for a, b in merged])
            counts = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            names = [c for c in part.schema.names if c not in ("text", "marks")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *counts], [*names, "n_words", "n_removed", "kept_sha256", "kept_text", "intervals"])

    return cut


def _repeated(rows: DataFrame) -> DataFrame:
    """With ``first``, the smallest document that has the row's (gram, whole).

    The minimum is combined before the shuffle. Only what occurs in several documents
    is looked up, from a table: then both sides of the join are plain shuffles, which
    Spark splits where a passage is in very many documents.
    """
    first = rows.groupBy("gram", "whole").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    found = written(first.select(F.col("gram").alias("g"), F.col("whole").alias("w"), "first"), "first-documents")
    joined = rows.join(found, (F.col("gram") == F.col("g")) & (F.col("whole") == F.col("w")), "left").drop("g", "w")
    return joined.withColumn("first", F.coalesce("first", "id"))


def _grams_in_several(runs: DataFrame) -> DataFrame:
    """The rows whose gram several documents have.

    Written: an aggregate by (gram, ...) right behind the join would take over the
    join's partitions by gram, and then Spark couldn't split a very common gram.
    """
    found = runs.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("gram")
    return written(runs.join(written(found, "shared-grams"), "gram", "left_semi"), "runs-of-shared-grams")


def without_repeats(docs: DataFrame, carry: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """doc_id, ``carry`` of docs, n_words, n_removed, kept_sha256, kept_text and the removed intervals.

    Rows are matched by (doc_id, text hash). The runs, a few dozen bytes each, are
    written to the shared folder as they are read three times. So are a text's edges
    and marks, each a row, before they are joined: a join right behind their aggregate
    would take over its partitions, and Spark couldn't split one text that makes up a
    third of the table.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"c_{c}") for c in carry])
    texts = rows.select("id", "th", "text")
    runs = texts.mapInArrow(_runs(width), "id long, th long, gram long, whole long, place int, n int")
    runs = written(_repeated(_grams_in_several(written(runs, "window-runs"))), "shared-runs")
    marked = runs.where("first < id").select("id", "th", "place", "n")
    edges = _grams_in_several(runs.where("first = id")).groupBy("id", "th").agg(F.collect_set(F.struct("place", "n")).alias("runs"))
    windows = texts.join(written(edges, "edges"), ["id", "th"]).mapInArrow(_edge_windows(width), "id long, th long, gram long, whole long, place int")
    windows = _repeated(written(windows.distinct(), "edge-windows")).where("first < id").select("id", "th", "place", F.lit(1).alias("n"))
    marks = marked.unionByName(windows).groupBy("id", "th").agg(F.collect_set(F.struct("place", "n")).alias("marks"))
    held = [f for f in rows.schema.fields if f.name.startswith("c_")]
    schema = ", ".join(["id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in held), "n_words long, n_removed long, kept_sha256 string, kept_text string, intervals array<struct<start:int,end:int>>"])
    joined = rows.join(written(marks, "marks"), ["id", "th"], "left").select("id", *[f.name for f in held], "text", "marks")
    out = joined.mapInArrow(_without(width), schema)
    return out.select(F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), *[F.col(f"c_{c}").alias(c) for c in carry], "n_words", "n_removed", "kept_sha256", "kept_text", "intervals")
