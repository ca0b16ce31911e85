"""Quality scores from random-indexing word vectors and a small calibrated network.

Words and runs of punctuation are counted over all documents. Each of the VOCABULARY
most frequent ones has a row of its own; all rarer ones share SHARED rows by hash, so
the table of vectors has a fixed size. Each row has a fixed sparse random index
vector; a word's vector is the sum of the index vectors found within two words of it,
over all documents: tasks add up what they read, and Spark sums over tasks. A document
is the mean of its words' directions, plain and weighted against frequent words. A
two-layer numpy network is trained on labelled documents of the training fold, and a
temperature, fitted on labelled documents that the network hasn't seen, makes its
outputs probabilities. Only the text is an input.

Edge cases: a null or empty text is the zero vector and has a score like any other;
without labels of both kinds every score is the share of good labels (0 if unknown);
repeated rows score alike; an empty table gives no rows; further columns are
ignored. The word vectors cover all texts; the fit uses at most MOST_LABELLED rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .folds import held_out, labelled_texts
from .hashing import WORDS_AND_MARKS, word_hashes

MOST_LABELLED = 40_000
#: Words with a row of their own, rows that rarer words share, dimensions, non-zeros of an index vector, words on either side.
VOCABULARY, SHARED, DIMENSIONS, NON_ZEROS, REACH = 1 << 15, 1 << 13, 64, 4, 2
HIDDEN, STEPS, BATCH, RATE, DECAY, HOLDOUT = 32, 2_000, 1_024, 0.003, 2e-3, 5
#: Words that are summed or counted at a time.
_TOKENS = 1 << 18


@cache
def index_vectors(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of each row's index vector."""
    rng = np.random.default_rng(8)
    return np.argsort(rng.random((rows, DIMENSIONS)), axis=1)[:, :NON_ZEROS], rng.choice([-1, 1], (rows, NON_ZEROS))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Hashes of all words of some texts, and the number of words of each text."""
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            part = batch.slice(k, 128)
            yield part, *word_hashes(part.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), WORDS_AND_MARKS)


def _numbered(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, shared: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, in the table of vectors, of all words of some texts; ``vocabulary`` is sorted."""
    for part, hashes, counts in _hashed(batches):
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
        own = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        yield part, np.where(own, at, len(vocabulary) + (hashes % np.uint64(shared)).astype(np.int64)), counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word (its hash) and n, combined over some hundred thousand words at a time."""
    held, n = [np.empty(0, np.uint64)], 0

    def rows() -> pa.RecordBatch:
        words, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times.astype(np.int64))], ["word", "n"])

    for _, hashes, _ in _hashed(batches):
        held.append(hashes)
        n += len(hashes)
        if n > 8 * _TOKENS:
            yield rows()
            held, n = [np.empty(0, np.uint64)], 0
    yield rows()


def frequent_words(docs: DataFrame, most: int = VOCABULARY) -> np.ndarray:
    """Sorted hashes of the ``most`` most frequent words of all texts, ties by hash."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.col("n").desc(), "word").limit(most).select("word").toPandas()
    return np.sort(found.word.to_numpy(np.int64).view(np.uint64))


def add_contexts(sums: np.ndarray, row: np.ndarray, text: np.ndarray) -> None:
    """Adds to each row of ``sums`` the index vectors within REACH words of its words; ``text`` tells texts apart."""
    places, signs = index_vectors(len(sums))
    flat = sums.reshape(-1)
    for off in range(1, REACH + 1):
        inside = text[off:] == text[:-off]
        a, b = row[:-off][inside], row[off:][inside]
        for word, near in ((a, b), (b, a)):
            flat += np.bincount((word[:, None] * DIMENSIONS + places[near]).ravel(), weights=signs[near].ravel(), minlength=len(flat))


def _contexts(vocabulary: np.ndarray, shared: int):
    """row, n, and its summed context, of what a task reads."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = len(vocabulary) + shared
        sums, n = np.zeros((rows, DIMENSIONS)), np.zeros(rows, np.int64)
        held, texts, words = [], [], 0

        def add() -> None:
            row = np.concatenate(held)
            np.add(n, np.bincount(row, minlength=rows), out=n)
            add_contexts(sums, row, np.repeat(np.arange(len(texts)), texts))

        for _, row, counts in _numbered(batches, vocabulary, shared):
            held.append(row)
            texts += counts.tolist()
            words += len(row)
            if words > _TOKENS:
                add()
                held, texts, words = [], [], 0
        if words:
            add()
        met = np.flatnonzero(n)
        for k in range(0, len(met), 2048):
            at = met[k : k + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(c) for c in sums[at].astype(np.int64).T.copy())], ["row", "n", *(f"d{i}" for i in range(DIMENSIONS))])

    return contexts


def word_vectors(docs: DataFrame, vocabulary: np.ndarray, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """A direction for each row, and its share of all words: a table of fixed size."""
    names = [f"d{i}" for i in range(DIMENSIONS)]
    schema = ", ".join(f"{c} long" for c in ("row", "n", *names))
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts(vocabulary, shared), schema).groupBy("row").agg(*[F.sum(c).cast("float" if c != "n" else "long").alias(c) for c in ("n", *names)])
    found = sums.toPandas()
    vectors, share = np.zeros((len(vocabulary) + shared, DIMENSIONS), np.float32), np.zeros(len(vocabulary) + shared)
    if len(found):
        raw = found[names].to_numpy(np.float64)
        raw /= found[["n"]].to_numpy(np.float64)
        raw -= np.average(raw, axis=0, weights=found["n"].to_numpy(np.float64))  # what all words share says nothing
        vectors[found.row] = raw / np.maximum(np.sqrt((raw**2).sum(1, keepdims=True)), 1e-12)
        share[found.row] = found["n"] / found["n"].sum()
    return vectors, share


def pooled(row: np.ndarray, counts: np.ndarray, vectors: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Plain and weighted mean of each text's word directions: counts of rows by texts, times the directions.

    In 64-bit floats, so that which texts are counted together doesn't show in a score.
    """
    weight = 1e-3 / (1e-3 + share)
    begins = np.concatenate([[0], np.cumsum(counts)])
    sums, total = np.zeros((len(counts), 2 * DIMENSIONS)), np.zeros(len(counts))
    for k in range(0, len(counts), 64):
        some = row[begins[k] : begins[min(k + 64, len(counts))]]
        met = np.zeros(len(vectors), bool)
        met[some] = True
        used, at = np.flatnonzero(met), np.cumsum(met) - 1
        n = counts[k : k + 64]
        held = np.bincount(np.repeat(np.arange(len(n)), n) * len(used) + at[some], minlength=len(n) * len(used)).reshape(len(n), -1).astype(np.float64)
        directions = vectors[used].astype(np.float64)
        sums[k : k + 64, :DIMENSIONS] = held @ directions
        held *= weight[used]
        sums[k : k + 64, DIMENSIONS:] = held @ directions
        total[k : k + 64] = held.sum(1)
    sums[:, :DIMENSIONS] /= np.maximum(counts, 1)[:, None]
    sums[:, DIMENSIONS:] /= np.maximum(total, 1e-12)[:, None]
    return sums


def _pooled_rows(vocabulary: np.ndarray, vectors: np.ndarray, share: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, counts in _numbered(batches, vocabulary, len(share) - len(vocabulary)):
            x = pooled(row, counts, vectors, share)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())], ["doc_id", "y", "x"])

    return rows


class Network:
    """Scaled inputs, a tanh layer, a logit divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        unseen, seen = order[::HOLDOUT], np.delete(order, np.s_[::HOLDOUT])
        self.mean, self.scale = x[seen].mean(0), np.maximum(x[seen].std(0), 1e-6)
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
        self.temperature = 1.0
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        z = (x - self.mean) / self.scale
        for t in range(1, STEPS + 1):
            rows = rng.choice(seen, min(BATCH, len(seen)))
            for i, g in enumerate(self._gradients(z[rows], y[rows])):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
                self.w[i] = self.w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        logits = self.logits(x[unseen])
        grid = np.geomspace(0.25, 16, 97)
        loss = [np.logaddexp(0, np.where(y[unseen] == 1, -1, 1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -60, 60))) - y) / len(y)
        back = np.outer(d, self.w[2]) * (1 - h**2)
        return [z.T @ back + DECAY * self.w[0], back.sum(0), h.T @ d + DECAY * self.w[2], d.sum()]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]) / self.temperature

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))


def _scored(vocabulary: np.ndarray, vectors: np.ndarray, share: np.ndarray, network: Network | None, prior: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, counts in _numbered(batches, vocabulary, len(share) - len(vocabulary)):
            scores = network.probabilities(pooled(row, counts, vectors, share)) if network else np.full(part.num_rows, prior)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    return scored


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MOST_LABELLED, most_words: int = VOCABULARY, shared: int = SHARED) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; three passes over the texts, no shuffle of them."""
    vocabulary = frequent_words(docs, most_words)
    vectors, share = word_vectors(docs, vocabulary, shared)
    sample = written(labelled_texts(docs, labels, "quality", most).mapInArrow(_pooled_rows(vocabulary, vectors, share), "doc_id long, y int, x binary"), "quality-sample")
    rows = sample.orderBy(F.xxhash64("doc_id"), "y", "x").toPandas()  # bounded: the sample's pooled vectors
    y = rows.y.to_numpy(np.float64)
    network = Network(np.frombuffer(b"".join(rows.x), "<f4").reshape(len(y), -1).astype(np.float64), y) if len(set(y)) == 2 and len(y) > HOLDOUT else None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    scores = texts.mapInArrow(_scored(vocabulary, vectors, share, network, float(y.mean()) if len(y) else 0.0), "doc_id long, held_out boolean, score double")
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
