"""Parts of the two classifiers against plain Python: risk gradients, feature counts, word vectors, temperature."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm import hashing, quality_classifier, toxicity

SCHEMA = "doc_id long, text string, y int"


def test_risk_gradients_are_finite_differences():
    rng = np.random.default_rng(2)
    a, b, w, prior = rng.integers(0, 2, (9, 4)).astype(float), rng.integers(0, 2, (30, 4)).astype(float), rng.normal(size=4), 0.2
    _, _, slope_toxic, slope_clean = toxicity.risk(w, a, b, prior)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        up, down = toxicity.risk(w + e, a, b, prior), toxicity.risk(w - e, a, b, prior)
        assert slope_toxic[i] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-6)
        assert slope_clean[i] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-6)


def test_risk_is_that_of_the_definition():
    a, b, w, prior = np.array([[1.0, 1.0]]), np.array([[0.0, 1.0], [1.0, 1.0]]), np.array([0.7, -0.2]), 0.3
    loss = lambda g: 1 / (1 + math.exp(g))
    toxic, clean, _, _ = toxicity.risk(w, a, b, prior)
    assert toxic == pytest.approx(prior * loss(0.5))
    assert clean == pytest.approx((loss(0.2) + loss(-0.5)) / 2 - prior * loss(-0.5))


def test_features_are_those_of_greatest_ratio(spark):
    rng = random.Random(3)
    made = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "Echo"]) for _ in range(6)) + (" villain" if i % 4 == 0 else ""), 1 if i % 4 == 0 else None) for i in range(120)] + [(7, None, None), (8, "", None)]
    p, u = Counter(), Counter()
    for _, text, y in made:
        has = set(toxicity.text_features([(text or "").encode()])[1].tolist())
        u.update(has)
        p.update(has if y else ())
    n_p, n_u = 30, len(made)

    def ratio(x):
        rate = (p[x] + u[x]) / (n_p + n_u)
        return sum(n * math.log(n / (of * rate)) for n, of in ((p[x], n_p), (u[x], n_u)) if n)

    want = sorted((x for x in p if p[x] >= toxicity.LEAST_TEXTS and ratio(x) >= toxicity.LEAST_RATIO), key=lambda x: (-round(ratio(x), 9), x))
    docs, empty = spark.createDataFrame(made, SCHEMA).repartition(3), spark.createDataFrame([], SCHEMA)
    assert want and toxicity.chosen_features(docs.where("y = 1"), docs) == want
    assert toxicity.chosen_features(empty, docs) == toxicity.chosen_features(empty, empty) == []


def test_features_are_words_and_beginnings():
    texts = ["The the (the) cats' cat-sat", "", "Überall überall 123456789", "a b a b", "x" * 70_000 + " end"]
    text, value = toxicity.text_features([t.encode() for t in texts])
    assert len(set(zip(text.tolist(), value.tolist()))) == len(text)
    seen = {}
    for i, t in enumerate(texts):
        words = {w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.encode().lower()) if w}
        want = {(0, w) for w in words} | {(n, w[:n]) for w in words for n in toxicity.BEGINNINGS if len(w) > n}
        assert int((text == i).sum()) == len(want)
        seen[i] = want
    shared = lambda i, j: len(set(value[text == i].tolist()) & set(value[text == j].tolist()))
    again = toxicity.text_features([b"cat sat the", b"cats"])
    assert len(set(again[1][again[0] == 0].tolist()) & set(value[text == 0].tolist())) == 3 and shared(0, 2) == 0
    only = value[(text == 2)][:2]
    bits = np.zeros(toxicity.FILTER_BITS >> 6, np.uint64)
    for v in only.tolist():
        bits[v % toxicity.FILTER_BITS >> 6] |= np.uint64(1 << (v & 63))
    assert set(only.tolist()) <= set(toxicity.text_features([t.encode() for t in texts], bits)[1].tolist())


def test_the_filter_has_a_bit_for_every_feature(spark):
    found = [0, 5, 2**62 + 77, 2**63 - 1, toxicity.FILTER_BITS, 64, 63, toxicity._ANY]
    bits = toxicity.feature_bits(spark.createDataFrame([(x,) for x in found], "feature long"))
    want = {x % toxicity.FILTER_BITS for x in found}
    assert {64 * i + b for i in np.flatnonzero(bits) for b in range(64) if int(bits[i]) >> b & 1} == want


def test_only_confirmed_toxic_labels_matter(spark):
    """Which rows without a toxic mark have a label is not looked at, as long as the prior stays."""
    rng = random.Random(6)
    made = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(20)) + (" nasty" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    toxic = [(i, 1) for i in range(0, 400, 5)]
    clean = [i for i in range(400) if i % 5]
    fold = docs.select("doc_id").where(~toxicity.held_out()).collect()
    clean = [i for i in clean if i in {r.doc_id for r in fold}]
    scores = [
        sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.createDataFrame(toxic + [(i, 0) for i in part], "doc_id long, toxic int")).collect())
        for part in (clean[:100], clean[-100:])
    ]
    assert scores[0] == scores[1] and sum(s > 0.5 for _, s in scores[0]) == 80


def rows_of(texts, vocabulary, shared):
    out = []
    for t in texts:
        hashes, _ = hashing.word_hashes([t.encode()], hashing.WORDS_AND_MARKS)
        out.append([vocabulary.tolist().index(h) if h in vocabulary else len(vocabulary) + int(h) % shared for h in hashes.tolist()])
    return out


def test_word_vectors_are_sums_of_index_vectors(spark):
    rng = random.Random(4)
    texts = ["", "one", "a, b", *[" ".join(rng.choice(["red", "green", "blue.", "x" * rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 40))) for _ in range(30)]]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3)
    vocabulary, shared = quality_classifier.frequent_words(docs, 5), 4
    counts = Counter(h for t in texts for h in hashing.word_hashes([t.encode()], hashing.WORDS_AND_MARKS)[0].tolist())
    assert sorted(vocabulary.tolist()) == sorted(h for h, _ in sorted(counts.items(), key=lambda x: (-x[1], np.uint64(x[0]).view(np.int64)))[:5])
    places, signs = quality_classifier.index_vectors(9)
    index = np.zeros((9, quality_classifier.DIMENSIONS))
    for r in range(9):
        index[r, places[r]] = signs[r]
    sums, n = np.zeros_like(index), np.zeros(9)
    for row in rows_of(texts, vocabulary, shared):
        for i, r in enumerate(row):
            n[r] += 1
            for j in range(max(0, i - 2), min(len(row), i + 3)):
                if j != i:
                    sums[r] += index[row[j]]
    met = n > 0
    mean = sums[met] / n[met, None]
    mean -= np.average(mean, axis=0, weights=n[met])
    vectors, share = quality_classifier.word_vectors(docs, vocabulary, shared)
    assert np.allclose(share, n / n.sum())
    assert np.allclose(vectors[met], mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12), atol=1e-5) and not vectors[~met].any()


def test_pooling_is_a_mean(spark):
    rng = np.random.default_rng(1)
    vectors, share = rng.normal(size=(6, quality_classifier.DIMENSIONS)).astype(np.float32), np.array([0.5, 0.2, 0.1, 0.1, 0.05, 0.05])
    vectors = vectors.astype(np.float64)
    texts = [[0, 1, 1], [], [5], rng.integers(0, 6, 9000).tolist(), *([[3]] * 150)]
    got = quality_classifier.pooled(np.array(sum(texts, [])), np.array(list(map(len, texts))), vectors, share)
    for x, row in zip(got, texts, strict=True):
        weight = 1e-3 / (1e-3 + share[row])
        want = [vectors[row].mean(0), (vectors[row] * weight[:, None]).sum(0) / weight.sum()] if row else [np.zeros(64)] * 2
        assert np.allclose(x, np.concatenate(want), atol=1e-6)


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    y = (x[:, 0] + 1.5 * rng.normal(size=600) > 0).astype(float)
    net = quality_classifier.Network(x, y)
    unseen = np.random.default_rng(0).permutation(600)[:: quality_classifier.HOLDOUT]
    best = net.temperature
    losses = {}
    for t in np.geomspace(0.25, 16, 400):
        net.temperature = t
        z = net.logits(x[unseen])
        losses[t] = np.logaddexp(0, np.where(y[unseen] == 1, -1, 1) * z).mean()
    assert math.log(best / min(losses, key=losses.get)) == pytest.approx(0, abs=0.05)


def test_network_gradients_are_finite_differences():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(40, 5)), rng.integers(0, 2, 40).astype(float)
    net = quality_classifier.Network(x, y)
    z = (x - net.mean) / net.scale

    def loss():
        h = np.tanh(z @ net.w[0] + net.w[1])
        g = h @ net.w[2] + net.w[3]
        return np.logaddexp(0, np.where(y == 1, -g, g)).mean() + quality_classifier.DECAY / 2 * ((net.w[0] ** 2).sum() + (net.w[2] ** 2).sum())

    grads = net._gradients(z, y)
    for i, at in ((0, (2, 3)), (1, (4,)), (2, (6,)), (3, ())):
        held = np.array(net.w[i])
        sides = []
        for e in (1e-6, -1e-6):
            net.w[i] = held.copy()
            net.w[i][at] += e
            sides.append(loss())
        net.w[i] = held
        assert np.asarray(grads[i])[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-5)


def test_quality_labels_of_the_other_fold_are_not_read(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["good", "fine", "word"]) if i % 2 else rng.choice(["junk", "###", "word"]) for _ in range(30))) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality_classifier.quality(docs, x).collect()) for x in (labels, flipped))
    assert a == b
    by = defaultdict(list)
    for i, s in a:
        by[i % 2].append(s)
    assert np.mean(by[1]) > 0.9 and np.mean(by[0]) < 0.1
