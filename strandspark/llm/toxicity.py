"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic examples are used as labels. Unlabelled text is drawn from all
documents of the training fold, with or without a label, which is not looked at: the
mixture that the class prior is a share of. The prior is the share of toxic rows
among all labelled rows of that fold. A text is the set of its words and their
beginnings; Spark counts these over all documents of the training fold, and those
that divide confirmed toxic texts from the mixture best, by the log-likelihood ratio,
are the model's features. A few linear numpy classifiers are trained on bootstrap
draws, by the prior-corrected risk with sigmoid loss: when the estimated risk of the
negatives falls below zero, the step goes the other way. The score is the mean of
their probabilities. Only the text is an input.

Edge cases: a null or empty text has no features and the score of the bias; without
toxic examples, or without any labels, every score is the prior (0 if unknown);
repeated rows score alike; rows under a toxic id are all toxic texts in the counts; an
empty table gives no rows; further columns are ignored. The fit uses at most
MOST_POSITIVE toxic and MOST_UNLABELLED unlabelled texts; prior and counts cover all
rows, and scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import WORDS_AND_MARKS, joined, scrambled, span_hashes, word_spans
from .folds import held_out, least_hashed, texts_of, training_labels

#: Bounds of the fit: toxic texts, unlabelled texts, features.
MOST_POSITIVE, MOST_UNLABELLED, FEATURES = 10_000, 30_000, 1_024
#: A feature is in so many toxic texts at least; beginnings of words, in bytes.
LEAST_TEXTS, BEGINNINGS = 3, (4, 5, 6)
#: Least log-likelihood ratio of a feature: about one in 100,000 by chance.
LEAST_RATIO = 10.0
MEMBERS, STEPS, BATCH, RATE, DECAY = 3, 1_200, 1_024, 0.02, 1e-5
#: Features of texts that a task holds before it counts them and passes them on.
COUNTED_FEATURES = 4_000_000
#: Bits of the filter of features that toxic texts have: one megabyte.
FILTER_BITS = 1 << 23
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _apart(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where the first of each pair of a text and a value is, in ascending order."""
    pair = scrambled(value + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.unique(pair, return_index=True)[1])


def text_features(texts: list[bytes], bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a text and a feature, each once: its distinct lower-case words, without marks, and their beginnings, as hashes.

    With ``bits`` only features whose bit is set.
    """
    buffer, begins = joined(texts)
    buffer = _LOWER[buffer]
    starts, ends = word_spans(buffer, WORDS_AND_MARKS)
    word = WORDS_AND_MARKS[buffer[starts]] == 1
    starts, ends = starts[word], ends[word]
    text = np.searchsorted(begins, starts, "right") - 1
    hashes = span_hashes(buffer, starts, ends)
    first = _apart(text, hashes)
    starts, ends, text = starts[first], ends[first], text[first]
    found = [(text, hashes[first])]
    for n in BEGINNINGS:
        longer = ends - starts > n
        found.append((text[longer], scrambled(span_hashes(buffer, starts[longer], starts[longer] + n), n)))
    text, value = (np.concatenate(x) for x in zip(*found, strict=True))
    value >>= np.uint64(1)
    if bits is not None:
        at = value % np.uint64(FILTER_BITS)
        kept = (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        text, value = text[kept], value[kept]
    first = _apart(text, value)
    return text[first], value[first].view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            part = batch.slice(k, 128)
            yield part, part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()


#: Stands for no feature: what every text has.
_ANY = -1


def _counted(bits: np.ndarray | None):
    """feature, and the texts that have it; a task adds up what it meets. With ``bits`` only features whose bit is set."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_texts = [], 0, 0

        def rows() -> pa.RecordBatch:
            features, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(features), pa.array(n.astype(np.int64))], ["feature", "n"])

        for _, texts in _parts(batches):
            held.append(text_features(texts, bits)[1])
            size += len(held[-1])
            n_texts += len(texts)
            if size > COUNTED_FEATURES:
                yield rows()
                held, size = [], 0
        held.append(np.full(n_texts, _ANY))
        yield rows()

    return counted


def feature_counts(texts: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    return texts.select("text").mapInArrow(_counted(bits), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def feature_bits(features: DataFrame) -> np.ndarray:
    """A bit for each remainder that a feature has: a filter of fixed size, whatever the number of features."""
    at = F.pmod("feature", F.lit(FILTER_BITS))
    words = features.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(feature, 64) AS INT))")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    for r in words:
        out[r.word] = r.bits & (2**64 - 1)
    return out


def ratio(p: Column, u: Column, n_p: float, n_u: float) -> Column:
    """Log-likelihood ratio of p in n_p toxic texts and u in n_u texts of the mixture, against one common rate."""
    rate = (p + u) / (n_p + n_u)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (n * rate))).otherwise(0.0)
    return part(p, n_p) + part(u, n_u)


def chosen_features(toxic: DataFrame, mixture: DataFrame, most: int = FEATURES) -> list[int]:
    """The hashes of the features that divide the texts of ``toxic`` best from those of ``mixture``, in either direction.

    The mixture's texts are counted for the features that toxic texts have, which a
    filter of bits tells with a few false ones, and these go in the join.
    """
    p = written(feature_counts(toxic).where(F.col("n") >= LEAST_TEXTS).withColumnRenamed("n", "p"), "toxic-features")
    n_toxic = p.where(F.col("feature") == _ANY).first()
    if n_toxic is None:
        return []
    u = written(feature_counts(mixture, feature_bits(p)).withColumnRenamed("n", "u"), "mixture-features")
    n_mixture = u.where(F.col("feature") == _ANY).first()
    rated = p.where(F.col("feature") != _ANY).join(u, "feature").select("feature", ratio(F.col("p").cast("double"), F.col("u").cast("double"), float(n_toxic.p), float(n_mixture.u)).alias("ratio"))
    return [r.feature for r in rated.where(F.col("ratio") >= LEAST_RATIO).orderBy(F.col("ratio").desc(), "feature").limit(most).collect()]


def _found(texts: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and number, in the sorted ``index``, of each of the model's features in each text; ordered."""
    text, value = text_features(texts)
    at = np.minimum(np.searchsorted(index, value), max(0, len(index) - 1))
    known = index[at] == value if len(index) else np.zeros(len(value), bool)
    order = np.lexsort((at[known], text[known]))
    return text[known][order], at[known][order]


def _sparse(index: np.ndarray):
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches):
            text, at = _found(texts, index)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "toxic", "drawn")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32)))], ["doc_id", "toxic", "drawn", "has"])

    return sparse


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk(w: np.ndarray, a: np.ndarray, b: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk of calling toxic texts clean, that of calling clean ones toxic, and their gradients.

    ``a`` are toxic rows, ``b`` rows of the mixture, with l(g) = sigmoid(-g). The clean
    texts' risk is the mixture's less the toxic texts' share: E_u[l(-g)] - prior E_p[l(-g)].
    """
    sp, su = sigmoid(a @ w), sigmoid(b @ w)  # l(-g) = sigmoid(g)
    slope_p, slope_u = (sp * (1 - sp)) @ a / len(a), (su * (1 - su)) @ b / len(b)
    return prior * (1 - sp).mean(), su.mean() - prior * sp.mean(), -prior * slope_p, slope_u - prior * slope_p


def fitted(toxic: np.ndarray, mixture: np.ndarray, prior: float, seed: int) -> np.ndarray:
    """Weights, the bias last, of one classifier.

    The non-negative risk is that of the toxic texts and, at least 0, that of the clean
    ones; where the latter's estimate is below 0 only its gradient is followed, upwards.
    """
    rng = np.random.default_rng(seed)
    of_p, of_u = rng.choice(len(toxic), len(toxic)), rng.choice(len(mixture), len(mixture))
    w = np.zeros(toxic.shape[1] + 1, np.float32)
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    with_bias = lambda x, rows: np.concatenate([x[rows].astype(np.float32), np.ones((len(rows), 1), np.float32)], axis=1)
    for t in range(1, STEPS + 1):
        a, b = with_bias(toxic, rng.choice(of_p, min(len(of_p), BATCH // 2))), with_bias(mixture, rng.choice(of_u, min(len(of_u), BATCH)))
        _, clean, slope_toxic, slope_clean = risk(w, a, b, prior)
        grad = slope_toxic + slope_clean if clean >= 0 else -slope_clean
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64)


def model_of(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted features, a row of weights for each classifier, and the prior.

    The driver holds the bounded sample's rows as bits of the chosen features.
    """
    marks = written(training_labels(labels, "toxic"), "toxicity-labels")
    n_toxic, n_all = marks.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    prior = n_toxic / n_all if n_all else 0.0
    if not n_toxic:
        return np.empty(0, np.int64), np.zeros((0, 1)), prior
    confirmed = marks.where("y = 1").select("doc_id")
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out())
    index = np.sort(np.array(chosen_features(train.join(confirmed, "doc_id", "left_semi"), train), np.int64))
    drawn = least_hashed(train.select("doc_id").where("doc_id IS NOT NULL").distinct(), most_unlabelled)
    ids = least_hashed(confirmed, most_positive).selectExpr("doc_id", "1 AS toxic", "0 AS drawn").unionByName(drawn.selectExpr("doc_id", "0 AS toxic", "1 AS drawn"))
    sample = written(texts_of(train, ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("drawn").alias("drawn"))), "toxicity-sample")
    rows = sample.mapInArrow(_sparse(index), "doc_id long, toxic int, drawn int, has array<int>").orderBy(F.xxhash64("doc_id"), "doc_id")
    x, sides = np.zeros((most_positive + most_unlabelled, max(1, len(index))), np.uint8), ([], [])
    for i, row in enumerate(rows.toLocalIterator()):
        x[i, row.has] = 1
        for side, of in zip(sides, (row.toxic, row.drawn), strict=True):
            side += [i] * of
    if not all(sides):
        return np.empty(0, np.int64), np.zeros((0, 1)), prior
    return index, np.array([fitted(x[sides[0]], x[sides[1]], prior, seed) for seed in range(MEMBERS)]), prior


def _scored(index: np.ndarray, weights: np.ndarray, prior: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches):
            scores = np.full(len(texts), prior)
            if len(weights):
                text, at = _found(texts, index)
                scores = np.mean([sigmoid(np.bincount(text, weights=w[at], minlength=len(texts)) + w[-1]) for w in weights], axis=0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return scored


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; scoring is one pass without a shuffle."""
    index, weights, prior = model_of(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    scores = rows.mapInArrow(_scored(index, weights, prior), "doc_id long, held_out boolean, score double")
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


