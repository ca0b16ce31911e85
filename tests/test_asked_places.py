"""Ranks of whole questions from the places of asked words: texts aren't shuffled, and results are those of words, stems and joins."""

import random
from collections import defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F
from test_whole_questions import density

from strandspark.functions.stemming import STEP_2, STEP_3, STEP_4, porter_stem
from strandspark.operators import fulltext
from strandspark.operators.rounds import lots


def shuffled(spark):
    executors = spark._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_words_are_not_shuffled(spark, tmp_path):
    """Ten times the text, in as many documents and files, shuffles no more than before; words were shuffled twice."""
    questions = spark.createDataFrame([(i, f"word{i} word{i + 1} word{i + 2}") for i in range(5)], "query_id long, text string")
    took = []
    for n in (200, 2000):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word"), (i * (F.col("id") + 7)) % 997)), " ")
        spark.range(0, 100, 1, 2).select("id", text.alias("text")).write.parquet(f"{tmp_path}/{n}")
        before = shuffled(spark)
        assert fulltext.density_ranked(spark.read.parquet(f"{tmp_path}/{n}"), questions, 3).count() == 15
        took.append(shuffled(spark) - before)
    assert took[1] < 1.5 * took[0]


@pytest.mark.parametrize("k", [1, 4, 100])
def test_lots_repeated_and_null_ids(spark, monkeypatch, k):
    """Rows of one id are one document, as they were; rows of one query are one query; null ids take no part."""
    monkeypatch.setattr(fulltext, "lots", partial(lots, most=3))
    monkeypatch.setattr(fulltext, "PLACES", 50)
    rng = random.Random(k)
    words = "connect connected queries query tables indexes session Kİte kite ays ies of the 7th".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    docs = [(i % 50 if i % 9 else 5, text(30)) for i in range(90)] + [(None, "query session"), (77, None), (78, ""), (5, None)]
    asked = [(i % 8, text(6)) for i in range(11)] + [(50, "nowhere"), (51, "of the"), (52, None), (None, "query")]
    docs_df, asked_df = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    at, wanted = defaultdict(lambda: defaultdict(list)), defaultdict(set)
    for r in fulltext.lexemes(docs_df.where("id IS NOT NULL")).collect():
        at[r.id][r.lexeme].append(r.at)
    for r in fulltext.lexemes(asked_df.where("query_id IS NOT NULL").withColumnRenamed("query_id", "id")).collect():
        wanted[r.id].add(r.lexeme)
    want = []
    for q, lexemes in wanted.items():
        rows = []
        for d, held in at.items():
            mine = sorted(lexemes & set(held))
            places = [(p, x) for x in mine for p in held[x]]
            if mine:
                rows.append((-len(mine), -density(places, len(mine)), d, len(places)))
        want += [(q, i, d, -n, hits, -s) for i, (n, s, d, hits) in enumerate(sorted(rows)[:k], 1)]
    got = fulltext.density_ranked(docs_df, asked_df, k).select("query_id", "rank", "id", "n_lexemes", "n_hits", "score").collect()
    assert sorted(map(tuple, got)) == [pytest.approx(x) for x in sorted(want)]


def test_stem_of_a_word(spark):
    """The function of a word agrees with the column expressions."""
    rng = random.Random(3)
    ends = [*(x[0] for x in (*STEP_2, *STEP_3)), *STEP_4, "ed", "eed", "ing", "s", "sses", "ies", "y", "ion", "tion", "e", "ll", "ly", "ss", "ated", "bling", "izing", "hopping", "filing"]
    heads = ["".join(rng.choice("aeiouybtlszdr7_") for _ in range(rng.randrange(6))) for _ in range(150)]
    words = sorted({h + e for h in heads for e in rng.sample(ends, 25)} | {h + a + b for h in heads for a, b in [rng.sample(ends, 2)]})
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words) if w and w not in fulltext.FUNCTION_WORDS], "id long, text string")
    wrong = [(words[r.id], r.lexeme) for r in fulltext.lexemes(rows).collect() if porter_stem(words[r.id]) != r.lexeme]
    assert not wrong
