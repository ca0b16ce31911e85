"""Output shards of the mix: what the draw decides, and that targets hold whatever it is."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(int(rng.integers(1, 90)))), "en", f"s{i % 3}", 0) for i in range(240)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", "en", None, 0), (900, None, "en", "s0", 0)], SCHEMA)


@pytest.mark.parametrize("totals, n", [((700, 250, 50), 100), ((5, 0, 3), 3), ((1,), 4), ((0, 0), 5), ((10**11, 10**10, 7), 10**10)])
def test_draws_keep_parts_and_totals(totals, n):
    sizes = mixing._parts(sum(totals), n)
    found = mixing.drawn(np.array(totals), sizes, np.random.default_rng(1))
    assert (found >= 0).all() and found.sum(0).tolist() == list(totals) and found.sum(1).tolist() == sizes.tolist() and sizes.sum() == sum(totals)


def test_draws_are_multinomial():
    """Over many draws a part's count of a source has the mean and the spread of a multinomial's, less what fixed totals take."""
    totals, n, parts = np.array([500, 300, 200]), 50, 20
    found = np.array([mixing.drawn(totals, np.full(parts, n), np.random.default_rng(i)) for i in range(600)])
    p = totals / totals.sum()
    assert np.abs(found.mean((0, 1)) - n * p).max() < 0.5
    spread, full = found.var((0, 1)), n * p * (1 - p)
    assert ((0.8 * full < spread) & (spread < 1.1 * full)).all()


def test_shards_have_their_size_and_follow_the_draw(spark, docs):
    _, targets = mixing.placed(docs, 16)
    of = {r.sid: r for r in targets.collect()}
    one, other = (mixing.slots_of(targets, 32, seed).collect() for seed in (17, 18))
    for slots in (one, other):
        sizes = Counter(r.shard for r in slots)
        assert sorted(sizes) == list(range(len(sizes))) and all(n == 32 for s, n in sizes.items() if s < len(sizes) - 1) and 0 < sizes[len(sizes) - 1] <= 32
        for sid, t in of.items():
            mine = [r for r in slots if r.sid == sid]
            assert sorted(r.slot for r in mine) == list(range(t.slots))
            assert max(Counter(r.block for r in mine).values(), default=0) <= 2
            assert all(r.block < t.blocks for r in mine)
    counts = lambda slots: Counter((r.shard, r.sid) for r in slots)
    assert counts(one) != counts(other)


def test_another_draw_changes_the_result_and_keeps_the_targets(docs):
    a, b = ([tuple(r) for r in mixing.mixed_sizes(docs, 16, 32, seed).collect()] for seed in (17, 18))
    assert Counter(a) != Counter(b) and len(a) == len(b) == 243
    for rows in (a, b):
        taken, target = Counter(), {}
        for _, size, source_size, goal, n, shard in rows:
            taken[source_size, goal] += n
            target[source_size, goal] = goal
            assert n <= 2 * size and (shard is None) == (n == 0)
        assert all(abs(taken[k] - t) <= 16 + 0.02 * t for k, t in target.items())
    assert Counter(a) == Counter(tuple(r) for r in mixing.mixed_sizes(docs.repartition(7), 16, 32).collect())


def test_written_shards_hold_the_blocks(spark, docs, tmp_path):
    mixing.write_shards(docs, f"file://{tmp_path}/mix", 16, 32)
    got = spark.read.parquet(f"file://{tmp_path}/mix").collect()
    text, taken = {r.doc_id: (r.text or "").split() for r in docs.collect()}, defaultdict(int)
    for r in got:
        w = r.words.split()
        assert text[r.doc_id][r["at"] : r["at"] + len(w)] == w and len(w) <= 16
        taken[r.doc_id] += len(w)
    want = Counter()
    for r in mixing.mixed_sizes(docs, 16, 32).collect():
        want[r.doc_id] += r.taken
    assert taken == +want
    slots = Counter((r.shard, r.source, r.slot) for r in got)
    assert len({s for s, _, _ in slots}) > 5 and max(Counter(s for s, _, _ in slots).values()) <= 32


def test_a_hundred_thousand_sources(spark):
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 5 + 1).cast("int")), " ").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 100_000).alias("source"), F.lit(0).cast("long").alias("n_chars"))
    found = mixing.mixed_sizes(docs, block=2, shard_slots=64)
    sums = found.agg(F.count(F.lit(1)), F.sum("size"), F.sum("taken"), F.max(F.col("taken") - 2 * F.col("size")), F.count_if((F.col("taken") > 0) != F.col("first_shard").isNotNull())).first()
    assert tuple(sums)[:2] == (120_000, 360_000) and abs(sums[2] / (1.5 * 360_000) - 1) < 0.2 and sums[3] <= 0 and sums[4] == 0


def test_one_row_repeated_for_a_third_is_split(spark):
    rows = spark.range(3_000).select(F.lit(7).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words").otherwise(F.concat(F.lit("words "), F.col("id"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    placed, _ = mixing.placed(rows, 4)
    assert placed.groupBy("start").count().where("count > 1").count() == 0
    tasks = placed.groupBy(F.spark_partition_id().alias("p")).count()
    assert placed.agg(F.max("start")).first()[0] + placed.orderBy(F.col("start").desc()).first()["size"] == placed.agg(F.sum("size")).first()[0] and tasks.count() >= 1
