"""The stored positional index against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandspark.functions.snowball import STOP_WORDS, english_stem
from strandspark.operators import positional
from strandspark.operators.positional import TextIndex, lexemes_of

WORDS = "connect connected queries query table indexes session engine thread locks lock commit the of driver _x 42".split()


def plain_rank(found, terms):
    """Sum over minimal spans with all terms, found by trying all spans between two places."""
    places = sorted((at, t) for t in terms for at in found.get(t, ()))
    spans = [(i, j) for i in range(len(places)) for j in range(i, len(places)) if {t for _, t in places[i : j + 1]} == set(terms)]
    least = [(i, j) for i, j in spans if not any((i, j) != (a, b) and i <= a and b <= j for a, b in spans)]
    return round(sum(0.1 / (1 + (places[j][0] - places[i][0]) - (j - i)) for i, j in least), 6)


def plain_top(docs, queries, k, mode, config, scope=None):
    out = []
    for q, text in queries:
        terms = sorted(lexemes_of(text, config))
        rows = []
        for i, grp, t in docs:
            found = lexemes_of(t, config)
            if not terms or i is None or (scope is not None and grp not in scope):
                continue
            if mode == "all" and all(t in found for t in terms):
                rows.append((-plain_rank(found, terms), i, grp))
            if mode == "any" and any(t in found for t in terms):
                rows.append((-round(0.1 * sum(len(found.get(t, ())) for t in terms), 6), i, grp))
        out += [(q, n, i, grp, pytest.approx(-s)) for n, (s, i, grp) in enumerate(sorted(rows, key=lambda r: r[:2])[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    docs = [(i, i % 4, " ".join(rng.choice(WORDS) for _ in range(int(rng.expovariate(0.08))))) for i in range(300)]
    docs += [(900, 0, None), (901, None, "query table lock"), (902, 1, ""), (None, 1, "query table lock"), (903, 1, "query " * 200 + "table"), (903, 1, "query " * 200 + "table")]
    queries = [(0, "the query of a table"), (1, "lock"), (2, "connected sessions"), (3, "the of"), (4, None), (5, "nowhere table"), (6, "driver 42 _x lock commit"), (7, "query query TABLE")]
    return docs, queries


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs, queries = corpus
    return spark.createDataFrame(docs, "id long, grp long, text string"), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("config", ["simple", "english"])
def test_ranks_equal_the_plain_formula(spark, corpus, frames, config, tmp_path):
    index = TextIndex(spark, f"plain_{config}", config).build(frames[0], f"file://{tmp_path}/t", buckets=3, block=16)
    try:
        for mode in positional.MODES:
            for k, scope in ((1, None), (7, None), (7, (1, 3)), (1000, None)):
                found = sorted(tuple(r) for r in index.top_k(frames[1], k, mode, scope).select("query_id", "rank", "id", "grp", "score").collect())
                assert found == plain_top(corpus[0], corpus[1], k, mode, config, scope)
    finally:
        index.drop()


def test_blocks_are_left_out_and_postings_are_not_shuffled(spark, frames, tmp_path):
    index = TextIndex(spark, "pruned", "simple").build(frames[0], f"file://{tmp_path}/t", buckets=4, block=8)
    try:
        assert 0 < index.searched_share(frames[1], 1, "all") < 0.6
        again = TextIndex(spark, "pruned", "simple")  # a later reader knows the tables only
        asked = again.asked(frames[1])
        pairs = asked.select("query_id").distinct().crossJoin(again.blocks.select("block").distinct().limit(3))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = again.ranked_in(pairs, asked, "any", None)._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in plan.split("Exchange") if "pruned_postings" in x)
        assert "SelectedBucketsCount: 4 out of 4" in scan or "Bucketed: true" in scan
        assert all("pruned_postings" not in x.split("Join")[0] for x in plan.split("Exchange")[1:]), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        index.drop()


def test_block_bounds_hold(spark, corpus, frames, tmp_path):
    index = TextIndex(spark, "bounded", "simple").build(frames[0], f"file://{tmp_path}/t", buckets=2, block=8)
    try:
        asked = index.asked(frames[1])
        for mode in positional.MODES:
            bounds = index._bounds(asked, mode)
            scores = index.ranked_in(bounds.select("query_id", "block"), asked, mode, None)
            of = index.postings.select("id", "block").distinct()
            over = scores.join(of, "id").join(bounds, ["query_id", "block"]).where(F.col("score") > F.col("bound") + 1e-6)
            assert over.count() == 0 and scores.count() > 0
    finally:
        index.drop()


def test_stems():
    stems = defaultdict(list)
    for word in "query queries connect connected connecting connection generate generic generously hoping hopped agreed skies dying succeed running possibly apology knightly conspiracies".split():
        stems[english_stem(word)].append(word)
    assert dict(stems) == {
        "queri": ["query", "queries"], "connect": ["connect", "connected", "connecting", "connection"], "generat": ["generate"], "generic": ["generic"], "generous": ["generously"], "hope": ["hoping"], "hop": ["hopped"],
        "agre": ["agreed"], "sky": ["skies"], "die": ["dying"], "succeed": ["succeed"], "run": ["running"], "possibl": ["possibly"], "apolog": ["apology"], "knight": ["knightly"], "conspiraci": ["conspiracies"],
    }
    assert english_stem("é1") == "é1" and english_stem("x86_64s") == "x86_64s" and len(STOP_WORDS) == 127


def test_modes_are_checked(spark, frames):
    with pytest.raises(ValueError):
        TextIndex(spark, "x", "german")
    with pytest.raises(ValueError):
        TextIndex(spark, "x").top_k(frames[1], 3, "some")
