"""Ids by merges and texts from ids against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandspark.llm import merges

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    plain = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


def test_every_character_as_by_the_library(library):
    model = merges.MergeModel(PATH)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 7 == 0)]
    texts = [f"a{c}b {c}{c} 1{c}2 .{c}. it{c}s'{c} e{c}" for c in points]
    for k in range(0, len(texts), 8192):
        some = texts[k : k + 8192]
        ids = [x.ids for x in library.encode_batch_fast(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(some)] == ids


def test_documents_and_odd_texts(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", "  \n ", "a<|endoftext|>b<|startoftext|> <|endoftext", "ΑΣ ΣΑΣ ΌΣΟΣ", "I'll we've 'S 'tis 12345", "x" * 30_000, "!?" * 20_000, "word " * 50_000, "a\x1cb \x1f c\x85d e", "é ẹ́ ́", "漢字かな 🙂🙃👩‍👩‍👧"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (None, "null id", "x")], "doc_id long, text string, ids string")
    found = merges.round_trip(docs, PATH).collect()
    wanted = [(i, *_digests(library, t)) for i, t in enumerate(texts)] + [(None, *_digests(library, "null id"))] * 2
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert merges.round_trip(docs.limit(0), PATH).collect() == []


def test_ids_then_texts(spark, library):
    docs = spark.createDataFrame([(1, "The stale entries of a queue are skipped"), (2, None)], "doc_id long, text string")
    ids = merges.encoded(docs, PATH)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: library.encode("The stale entries of a queue are skipped", add_special_tokens=False).ids, 2: []}
    assert {r.doc_id: r.text for r in merges.decoded(ids, PATH).collect()}[2] == ""


def test_small_caches_change_nothing(monkeypatch):
    texts = [f"some words{i} and more{i * 7} of them" for i in range(300)]
    whole = merges.MergeModel(PATH).encode(texts)
    monkeypatch.setattr(merges, "CACHED_WORDS", 10)
    monkeypatch.setattr(merges, "CACHED_PARTS", 10)
    model = merges.MergeModel(PATH)
    assert [x for k in range(0, 300, 20) for x in model.encode(texts[k : k + 20])] == whole
