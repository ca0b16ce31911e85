"""The pipeline stage by stage against plain Python, on documents written for it."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from strandspark.llm import mixing, simhash


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, made = text(60), []
    for i in range(120):
        t = text(rng.randrange(60, 260))
        t = t + " " + passage if i % 10 == 0 else t
        t = made[i - 1][1] if i % 15 == 4 else t
        t = "too short" if i % 20 == 7 else t
        t = "again and again " * 40 if i % 30 == 9 else t
        made.append((i, t, "en", f"s{i % 4}", len(t)))
    made += [(500, None, None, None, None), (501, "", "en", "s1", 0), (3, made[3][1], "en", "s3", len(made[3][1]))]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir, tmp_path):
    held = {"input": spark.read.parquet(f"{sf_dir}/documents.parquet")}
    docs = held["input"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = held[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(docs.columns) == ("doc_id", "text", "lang", "source", "n_chars")
    rows = {name: df.collect() for name, df in held.items()}

    def base_fails(t):
        w = (t or "").split()
        tri = Counter(zip(w, w[1:], w[2:]))
        return len(w) < 50 or 100 * len({i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}) > 50 * len(w)

    # too few bad labels here to certify a cutoff: the base rule alone decides
    good = Counter((r.doc_id, r.text) for r in rows["input"] if not base_fails(r.text))
    assert Counter((r.doc_id, r.text) for r in rows["quality_rules"]) == good
    prints = {r.doc_id: simhash.simhash(r.text.encode()) for r in rows["quality_rules"]}
    gone = {d for d in prints for e in prints if e < d and (prints[d] ^ prints[e]).bit_count() <= 4}
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(set(prints) - gone) and gone
    first, want = {}, {}
    for r in sorted(rows["near_duplicates"], key=lambda r: r.doc_id):
        w, cut = r.text.split(), set()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), r.doc_id) < r.doc_id:
                cut |= set(range(i, i + 50))
        if len(cut) < len(w):
            want[r.doc_id] = " ".join(x for i, x in enumerate(w) if i not in cut) if cut else r.text
    assert {r.doc_id: r.text for r in rows["repeated_passages"]} == want
    taken = Counter()
    for r in rows["mixing"]:
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    planned = {r.doc_id: r.taken for r in mixing.mixed_sizes(held["repeated_passages"]).collect()}
    assert taken == Counter({d: n for d, n in planned.items() if n})
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r.doc_id, r.n_tokens) for r in rows["pieces"]) == Counter((r.doc_id, len(library.encode(r.text))) for r in rows["mixing"])
    ended = Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert ended == Counter(map(tuple, rows["pieces"]))


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
