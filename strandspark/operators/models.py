"""Models from outside: embedding, generation, classification, judging, question drafting.

A model is given as a factory, a function without arguments that is called once in each
task and returns the model; so connections and weights are made where they are used.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels and confidences that a classification may have, and how much of its rationale is kept.
LABELS, CONFIDENCES, RATIONALE = ("bug", "feature", "usage", "unknown"), ("high", "medium", "low"), 1000
ESTIMATE = "automated_estimate_not_absolute_truth"
# End of the fixed values.


class Embedder(Protocol):
    """Texts to (index, vector) pairs, in any order; may raise ``Retry``."""

    def __call__(self, texts: list[str]) -> list[tuple[int, list[float]]]: ...


class Generator(Protocol):
    """A request, as text, to an answer; may raise ``Retry``."""

    def __call__(self, request: str) -> str: ...


class Retry(Exception):
    """What a model raises when the same call may succeed later."""


def patient(call: Callable, attempts: int = 6, most_wait: float = 60.0):
    """The call's result after at most ``attempts`` attempts, with doubling waits in between."""
    for attempt in range(attempts):
        try:
            return call()
        except Retry:
            if attempt == attempts - 1:
                raise
            time.sleep(min(most_wait, 2.0**attempt))
    raise ValueError("attempts must be positive")


class HashEmbedder:
    """Unit vectors that follow from the words of a text alone: no model, but deterministic and alike for like texts."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        out = []
        for i, text in enumerate(texts):
            v = np.zeros(self.dimensions)
            for word in text.lower().split():
                digest = hashlib.sha256(word.encode()).digest()
                v[int.from_bytes(digest[:4], "little") % self.dimensions] += 1 if digest[4] & 1 else -1
            out.append((i, (v / max(np.linalg.norm(v), 1e-12)).tolist()))
        return out


def embedded(rows: DataFrame, factory: Callable[[], Embedder], dimensions: int, batch: int = 100, attempts: int = 6, most_wait: float = 60.0) -> DataFrame:
    """id and embedding of every row (id, text), asked for in batches of at most ``batch`` texts.

    Answers are put in order by their index; a batch with a wrong number of answers or of
    dimensions is an error, so nothing half right is stored.
    """

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for held in batches:
            for k in range(0, held.num_rows, batch):
                part = held.slice(k, batch)
                texts = part.column("text").fill_null("").to_pylist()
                found = dict(patient(lambda: model(texts), attempts, most_wait))  # noqa: B023
                if sorted(found) != list(range(len(texts))):
                    raise ValueError(f"{len(texts)} texts were sent, and answers to {sorted(found)} came back")
                if any(len(v) != dimensions for v in found.values()):
                    raise ValueError(f"an embedding doesn't have {dimensions} dimensions")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([found[i] for i in range(len(texts))], pa.list_(pa.float32()))], ["id", "embedding"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("text").cast("string").alias("text")).mapInArrow(embed, f"id {kind}, embedding array<float>")


def reused_embeddings(cases: DataFrame, cached: DataFrame) -> DataFrame:
    """case_id, question and the cached embedding (case_id, question, embedding), null where the question isn't the cached one."""
    held = cached.select(F.col("case_id").alias("_id"), F.col("question").alias("_q"), "embedding")
    return cases.join(held, (F.col("case_id") == F.col("_id")) & (F.col("question") == F.col("_q")), "left").select("case_id", "question", "embedding")


def answered(rows: DataFrame, factory: Callable[[], Generator], attempts: int = 6, most_wait: float = 60.0) -> DataFrame:
    """``rows`` with answer, the model's reply to ``request``; null requests aren't sent."""
    names = [c for c in rows.columns]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for held in batches:
            replies = [None if r is None else patient(lambda: model(r), attempts, most_wait) for r in held.column("request").to_pylist()]  # noqa: B023
            yield pa.RecordBatch.from_arrays([*(held.column(c) for c in names), pa.array(replies, pa.string())], [*names, "answer"])

    return rows.mapInArrow(ask, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "answer string"]))


def classified(threads: DataFrame, factory: Callable[[], Generator]) -> tuple[DataFrame, DataFrame]:
    """Label, confidence and rationale of every thread (id, title, body), and the replies that break the contract.

    A reply is a JSON object with a known label and confidence and a rationale that isn't blank.
    """
    replies = answered(threads.select("id", F.to_json(F.struct("title", "body"), {"ignoreNullFields": "false"}).alias("request")), factory)
    x = F.from_json("answer", "label string, confidence string, rationale string")
    at = replies.select("id", "answer", x.alias("x"))
    said = F.trim(F.coalesce("x.rationale", F.lit("")))
    good = F.coalesce(F.col("x.label").isin(*LABELS) & F.col("x.confidence").isin(*CONFIDENCES) & (said != ""), F.lit(False))
    return at.where(good).select("id", "x.label", "x.confidence", F.substring(said, 1, RATIONALE).alias("rationale")), at.where(~good).select("id", "answer")


def judged(results: DataFrame, factory: Callable[[], Generator]) -> DataFrame:
    """case_id and a model's judgement of each result (case_id, question, answer, citations, verification_status), marked as an estimate.

    Replies that aren't such an object have nulls.
    """
    request = F.to_json(F.struct("question", "answer", F.col("citations").alias("retrieved_sources"), "verification_status"))
    replies = answered(results.select("case_id", request.alias("request")), factory)
    x = F.from_json("answer", "grounded boolean, citation_support boolean, abstention_appropriate boolean, brief_reason string")
    return replies.select("case_id", F.lit(ESTIMATE).alias("label"), x.alias("x")).select("case_id", "label", "x.*")


def drafted(threads: DataFrame, factory: Callable[[], Generator], most_body: int = 5000, most_comments: int = 4) -> tuple[DataFrame, DataFrame]:
    """A question for each thread (id, title, body, comments), and the drafts that are blank or that an earlier id has too.

    White space is collapsed. Body and comments are cut to the given sizes for the request, which is the method.
    """
    request = F.to_json(F.struct("title", F.substring("body", 1, most_body).alias("body"), F.slice(F.transform("comments", lambda c: c["body"]), 1, most_comments).alias("comments")))
    replies = answered(threads.select("id", request.alias("request")), factory)
    drafts = replies.select("id", F.btrim(F.regexp_replace(F.coalesce("answer", F.lit("")), r"(?U)\s+", " ")).alias("question"))
    first = drafts.where("question <> ''").groupBy("question").agg(F.min("id").alias("id"))
    return drafts.join(first, ["id", "question"], "left_semi"), drafts.join(first, ["id", "question"], "left_anti")
