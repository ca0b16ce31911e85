"""Rows that repeat a doc_id with unrelated texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandspark.llm import quality_rules, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_an_id_with_unrelated_texts_heads_several_groups(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8))) for _ in range(80))
    one, two, other = text(), text(), text()
    made = [(3, one), (3, two), (7, two), (9, two), (8, other), (3, one), (None, two)]
    for a, b in ((one, two), (one, other), (two, other)):
        assert (simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).bit_count() > 4
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in made], SCHEMA)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect())
    assert kept == Counter([(3, one), (3, two), (8, other), (None, two)])


@pytest.fixture
def heavy(spark):
    """Documents of which one row, with a passage that others have too, makes up a third; nothing is small enough to be broadcast."""
    rng = random.Random(5)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage = text(60)
    made = [(i, text(20) + " " + passage + " " + text(5) if i % 7 == 0 else text(90), "en", "s") for i in range(400)]
    docs = spark.createDataFrame(made + [made[21]] * 200, "doc_id long, text string, lang string, source string").repartition(8).select("*", F.length("text").cast("long").alias("n_chars"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield docs, passage.split(), made
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def may_split(df):
    """Whether the plan that ran has a join whose sides are scans and shuffles alone, which Spark may split."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "Aggregate" not in plan


def test_passages_of_a_row_repeated_for_a_third_of_the_table(heavy):
    docs, passage, made = heavy
    out = substring_dedup.without_repeats(docs, ("lang",))
    rows = out.collect()
    assert may_split(out)
    assert Counter(r.doc_id for r in rows) == Counter([i for i, *_ in made] + [21] * 200)
    assert {(r.doc_id, r.n_removed) for r in rows} == {(i, len(passage) if i % 7 == 0 and i else 0) for i, *_ in made}


def test_rules_on_a_row_repeated_for_a_third_of_the_table(spark, heavy):
    docs, _, made = heavy
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in made] + [(21, 1), (21, 1)], "doc_id long, quality int")
    rows = quality_rules.judged(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter([i for i, *_ in made] + [21] * 200)
    assert not any(r.base_failed for r in rows) and len({(r.doc_id, r.kept) for r in rows}) == len(made)


def test_a_label_is_no_aggregate_beside_its_join(spark, heavy):
    """The labelled rows' join may be split: what stands beside them is read from a table."""
    docs, _, made = heavy
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in made], "doc_id long, quality int")
    seen = []
    held = quality_rules.certified_cutoffs
    quality_rules.certified_cutoffs = lambda labelled, *rest: seen.append(labelled) or held(labelled, *rest)
    try:
        quality_rules.judged(docs, labels)
    finally:
        quality_rules.certified_cutoffs = held
    assert len(seen[0].collect()) == 600
    assert may_split(seen[0])
