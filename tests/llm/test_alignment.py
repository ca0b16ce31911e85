"""Cross-tokenizer alignment against the libraries on whole texts and plain counting."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from strandspark.llm import alignment
from strandspark.llm.merges import byte_letters

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _plain(texts):
    """The result's columns but doc_id, with byte offsets by running sums and links by documents."""
    a, b = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    data_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    data_b = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    each = []
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = ([data_a(i) for i in ids[0]], [data_b(i) for i in ids[1]])
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            each.append(None)
            continue
        ends = []
        for p in parts:
            at, sums = 0, []
            for x in p:
                at += len(x)
                sums.append(at)
            ends.append(sums)
        cuts, groups, i, j = sorted({*ends[0]} & {*ends[1]}), [], 0, 0
        for cut in cuts:
            x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((ids[0][i:x], ids[1][j:y]))
            i, j = x, y
        each.append((ids, groups, Counter((p, q) for x, y in groups for p in x for q in y)))
    documents = Counter(pair for x in each if x for pair in x[2])
    best = Counter()
    for (p, _), n in documents.items():
        best[p] = max(best[p], n)
    out = []
    for x in each:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids, groups, links = x
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((len(ids[0]), len(ids[1]), len(groups), links.total(), sum(k for pair, k in links.items() if documents[pair] == best[pair[0]]), sum(k * documents[pair] for pair, k in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def _texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()]
    texts += [None, "", " ", "  ", "\n", " \n x", "a  b   c\t d\n\n\ne \n", "tail  ", "tail\n", "▁mark", "x ▁ y", "<|endoftext|> <s> </s> <unk> <0x0A>", "漢字かな 🙂🙃 naïve ﬁ é", "\x00\x01 \x1c \x1fz\x85 q  　w", "=" * 3_001 + " " + "ab" * 2_000, "the the the " * 3_000]
    return texts + ["same text"] * 5


def _found(spark, texts, most):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, pairs int")
    return [tuple(r)[1:] for r in sorted(alignment.aligned(docs, FIRST, SECOND, most).collect())]


def test_equals_plain_counting_whatever_is_frequent(spark):
    texts = _texts(spark)
    plain = _plain(texts)
    for most in (alignment.FREQUENT, 300, 0):
        assert _found(spark, texts, most) == plain


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one two"), (3, "three")], "doc_id long, text string")
    found = [tuple(r) for r in alignment.aligned(docs, FIRST, SECOND).collect()]
    plain = _plain(["one two", "one two", "one two", "three"])
    assert sorted(found, key=str) == sorted([(None, *plain[0]), (None, *plain[1]), (3, *plain[2]), (3, *plain[3])], key=str)
    assert alignment.aligned(docs.limit(0), FIRST, SECOND).collect() == []


def test_transducer_states_are_residuals():
    machine = alignment.Transducer([b"ab", b"c", b"x"], [b"a", b"bc", b"abcd", b"d"])
    groups = alignment.Groups(machine, 4)
    found = groups.closed([0, 1], [0, 1])  # ab|c against a|bc
    assert [groups.texts[g] for g in found] == [b"0,1|0,1"]
    assert machine.residuals[1:] == [(0, b"ab"), (0, b"b"), (1, b"c")]
    assert sorted(zip(groups.pairs, groups.times, strict=True)) == [(0, 1), (1, 1), (4, 1), (5, 1)]
    moves = dict(machine.moves)
    assert groups.closed([0, 1, 0, 1], [0, 1, 0, 1]) == found * 2 and machine.moves == moves
    assert groups.closed([2], [0]) is None and groups.closed([0], [0]) is None and groups.closed([0, 1], [0, 1, 0]) is None and groups.closed([], []) == []


def test_small_caches_change_nothing(monkeypatch):
    texts = [f"word{i} and {i * 31} others, " * 3 + "\nline\n\n  end " for i in range(200)]
    whole = alignment.Aligner(FIRST, SECOND)
    expected = [whole.align([t]) for t in texts]
    monkeypatch.setattr(alignment, "CACHED_GROUPS", 5)
    monkeypatch.setattr(alignment, "CACHED_SPANS", 5)
    monkeypatch.setattr(alignment, "_CHARACTERS", 7)
    small = alignment.Aligner(FIRST, SECOND)
    for t, wanted in zip(texts, expected, strict=True):
        if small.full():
            small.forget()
        for a, b in zip(small.align([t]), wanted, strict=True):
            assert (a == b).all() if hasattr(a, "all") else a == b
