"""Viterbi over a whole public vocabulary, read as a unigram model, against the library."""

import os
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from strandspark.llm import pieces

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
ODD = ["", " ", "  two  spaces ", "a\nb\n\n", "żółć Привет 你好", "\0 ab", "x" * 3000, "▁mark ▁"]


def relabelled(change=lambda p: None):
    """The BPE vocabulary as a unigram model: ranks as scores, none below -40,000.

    The file gives pieces of marks alone a score of -1e9. With it the library's own
    optimized search misses the best path that its n-best search finds.
    """
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).serialized_model_proto())
    spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
    for p in spec.pieces:
        p.score = max(p.score, -40_000)
        change(p)
    model = pieces.PieceModel.__new__(pieces.PieceModel)
    model._load(spec)
    return SentencePieceProcessor(model_proto=spec.SerializeToString()), model


def differing(library, model, texts):
    return [t for t, x in zip(texts, model.encode(texts), strict=True) if np.array(library.encode(t), "<u4").tobytes() != x]


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the driver's tables")
def test_all_documents():
    """Scores are whole numbers, so the library's 32-bit sums are exact below 2**24: those of texts up to so many characters."""
    texts = [t for t in pq.read_table(DOCUMENTS, columns=["text"]).column("text").to_pylist() if t]
    library, model = relabelled()
    exact = [t for t in texts if sum(abs(model.scores[i]) for i in library.encode(t)) < 2**24]
    assert len(exact) > 0.95 * len(texts) and not differing(library, model, exact + ODD[:-1])


def test_unused_pieces_are_not_used():
    rng = random.Random(5)
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece

    def change(p):
        if p.type == kinds.NORMAL and len(p.piece) > 1 and rng.random() < 0.3:
            p.type = kinds.UNUSED

    library, model = relabelled(change)
    texts = ["".join(rng.choice("thereinsaod  ") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    assert not differing(library, model, texts)


def test_states_of_a_prefix_are_shared():
    """Words with a common prefix, learnt in one walk, have the ids of words learnt alone."""
    _, model = relabelled()
    words = [pieces.MARK + "inter" + x for x in ("", "n", "net", "national", "nationally", "est")]
    model.learn(words)
    together = dict(model.known)
    for w in words:
        model.known.clear()
        model.learn([w])
        assert model.known[w] == together[w]
