"""Each operator against brute force on a small table with nulls, ties, repeats, long and empty texts."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from strandspark.llm import components, cover_tree, hashing, mixing, pieces, quality_classifier, quality_rules, simhash, substring_dedup, token_files, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, bits string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéñ.") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(70), text(300)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, base), (5, base), (6, base + " more"), (7, passage + " " + text(40)), (8, text(30) + "\n" + passage + " " + text(30)), (9, passage)]
    out += [(10, "a b c " * 40), (11, "line of words here\n" * 30), (12, text(6000)), (13, "Ünï ΣΑΣ İ \x1c don't <|endoftext|> 你好 😀 ▁ x²"), (None, base), (None, None), (14, "x" * 5000)]
    out += [(20 + i, text(rng.randrange(1, 200))) for i in range(40)] + [(4, base), (20, "repeated id")]
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), len(t or ""), "x", "y", "z", "w") for d, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, int(d % 4 != 0), int(d % 6 == 0)) for d in range(60)] + [(None, 1, 1), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")


def words(text):
    return WORD.findall(text or "")


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, folder, shards=5)
    got = Counter(map(tuple, token_files.token_digests(spark, folder).collect()))
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    want, start, of = Counter(), 0, defaultdict(list)
    for r in rows():
        of[r[0]].append(ids(r[1]))
    shown = sorted((s, d, n, c) for (d, s, n, c), k in got.items() for _ in range(k))
    for s, d, n, c in shown:  # in file order: ascending ids, each row once, offsets without gaps
        assert s == start
        match = next(x for x in of[d] if (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) == (n, c))
        of[d].remove(match)
        start += n
    assert not any(of.values()) and not want
    order = [-1 if d is None else d for _, d, _, _ in shown]
    assert order == sorted(order)
    assert {tuple(r.ids) for r in token_files.read_token_files(spark, folder).where("doc_id = 3").collect()} == {tuple(ids("one two"))}
    assert token_files.tokenized(empty, path).count() == 0


def test_token_encoder_of_other_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_files.WordEncoder(path)
    assert encoder.parts is None and encoder.encode(["two words"]) == [np.asarray(encoder.tokenizer.encode("two words").ids, "<u4").tobytes()]


@pytest.mark.parametrize("shape", ["clusters", "same", "huge"])
def test_cover_tree(spark, shape):
    rng = np.random.default_rng(1)
    if shape == "clusters":
        x = (rng.normal(size=(9, 6))[rng.integers(0, 9, 900)] + 0.1 * rng.normal(size=(900, 6))).round(3).tolist()
    elif shape == "same":
        x = [[0.5, 0.25]] * 300 + [[1.0, -1.0]] * 5
    else:
        x = (rng.normal(size=(60, 3)) * 1e6).tolist()
    table = [(i, v) for i, v in enumerate(x)]
    table += [(1000, None), (1001, [1.0, None]), (1002, [float("nan"), 1.0]), (1003, [float("inf")]), (1004, []), (1005, [2.0]), (None, [1.0, 1.0]), (7, x[7])]
    df = spark.createDataFrame(table, "id long, vector array<double>")
    got = cover_tree.top_k(df, df.where("id % 10 = 0"), 4).collect()
    usable = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in table if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    want = []
    for i, v in {i: v for i, v in usable if i % 10 == 0}.items():
        best = sorted(((-score(v, w), j) for j, w in usable if j != i))[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert cover_tree.top_k(df.where("id < 0"), df.where("id < 0"), 4).count() == 0


def test_fingerprints_and_components(spark, docs, empty):
    def fingerprint(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = words(w)
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    table = [(r[0], fingerprint(r[1])) for r in rows()]
    prints = sorted({f for _, f in table})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in table:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    want = Counter((d, format(f, "016x"), least.get(find(f))) for d, f in table)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 400, np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    row, key = simhash.sought_keys(a)
    sought = set(zip(row.tolist(), key.tolist(), strict=True))
    row, key = simhash.filed_keys(b)
    met = {r for r, k in zip(row.tolist(), key.tolist(), strict=True) if (r, k) in sought}
    assert met == set(range(400))
    assert len(simhash.codewords(np.arange(5000), 3)[1]) == 5000  # perfect: one codeword within three bits


def test_dense_group_has_few_links(spark):
    near = [(1 << i) | (1 << j) for i in range(20) for j in range(i)] + [0]
    groups = simhash.grouped(spark.createDataFrame([(x,) for x in near], "bits long")).cache()
    pairs = sum((a ^ b).bit_count() <= 4 for i, a in enumerate(near) for b in near[:i])
    assert simhash.links(groups).count() < pairs / 5


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(380)] + [(i, i + 1) for i in range(500, 600)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components.least_of_component(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.least) for r in got} == {(x, find(x)) for x in root} and len(got) == len(root)
    assert components.least_of_component(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark, tmp_path):
    pages = [(i, f"http://x/{i}", t) for i, t in enumerate(["<p>" + "a" * 120, "<p>" + "a" * 120, "short", "short", None, "é" * 60, "é" * 60, "<p>" + "a" * 120])]
    pages += [(None, None, "é" * 60), (0, "http://x/0", "<p>" + "a" * 120), (90, "u", "r\r\n\r\nWARC/1.1\r\n" * 20), (91, "u", "long " * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.archived(df).collect()
    least = {}
    for i, _, t in pages:
        if t and len(t.encode()) >= 100 and i is not None:
            least[t] = min(least.get(t, i), i)
    want = Counter()
    for i, _, t in pages:
        first = least.get(t)
        refers = first if first is not None and first != i else None
        data = (t or "").encode()
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload).decode() == dict((p[0], p[2]) for p in pages)[r.page_id] for r in got if r.record_type == "response" and r.page_id in (90, 91))
    folder = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    warc.write_archives(df, folder)
    for path in (tmp_path / "w").glob("*.warc.zst"):
        data = path.read_bytes()
        magic, n = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_FRAME
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompressobj()
        assert one.decompress(data[8 + n :]).startswith(b"WARC/1.1\r\n") and one.eof  # the first record's own frame
    assert warc.archived(df.where("page_id > 1000")).count() == 0
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(b"\0" * 8)))


def test_quality_counts(docs, empty, labels):
    def counts(text):
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)

    got = quality_rules.judged(docs, labels).collect()
    want = Counter((r[0], *counts(r[1])) for r in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.judged(empty, labels).count() == 0 and quality_rules.judged(docs, labels.where("false")).count() == len(rows())


def test_binomial_bound(spark):
    from math import comb

    for k, n, p in [(0, 50, 0.01), (3, 400, 0.02), (20, 3000, 0.01)]:
        exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(quality_rules.lower_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert got == pytest.approx(exact, rel=1e-9)


def test_cutoffs_keep_the_risk(spark):
    rng = random.Random(6)
    made = [("a", 1, rng.random() * 0.04, 0.0, 0.0) for _ in range(2000)] + [("a", 0, rng.random(), 0.0, 0.0) for _ in range(500)] + [("b", 1, rng.random(), 0.0, 0.0) for _ in range(2000)] + [("b", 0, rng.random(), 0.0, 0.0) for _ in range(500)]
    found = {r.stratum: r for r in quality_rules.certified_cutoffs(spark.createDataFrame(made, "stratum string, quality int, symbol double, line double, repeat double")).collect()}
    assert found["a"].symbol_cutoff == 0.05 and found["a"].line_cutoff is None
    assert "b" not in found or found["b"].symbol_cutoff is None


def test_substring_dedup(docs, empty):
    first, want = {}, Counter()
    order = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    for r in order:
        w = words(r[1])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), 2**63 - 1 if r[0] is None else r[0])
    for r in order:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (2**63 - 1 if r[0] is None else r[0]):
                gone |= set(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        want[(r[0], len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    got = substring_dedup.without_repeats(docs, ("lang", "score")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert any(n for _, _, n, _ in want)
    assert all(sum(x["end"] - x["start"] for x in r.intervals) == r.n_removed for r in got)
    assert substring_dedup.without_repeats(empty).count() == 0


def test_hashes_agree_with_words():
    texts = [(r[1] or "").encode() for r in rows()]
    hashes, counts = hashing.word_hashes(texts)
    flat = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True)) and len(set(of.values())) == len(of)
    win = hashing.window_hashes(hashes, 3).tolist()
    by = {}
    assert all(by.setdefault(tuple(flat[i : i + 3]), h) == h for i, h in enumerate(win)) and len(set(by.values())) == len(by)
    x = np.random.default_rng(0).integers(0, 99, 50)
    assert all((hashing.sliding_min(x, n) == [x[i : i + n].min() for i in range(51 - n)]).all() for n in (1, 2, 7, 35))


def test_mixing(docs, empty):
    got = mixing.mixed_sizes(docs, block=16).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows())
    size = Counter()
    for r in rows():
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        left, w = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 2.0 * size[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    by = {round(r.target, 6) for r in got}
    assert by == {round(t, 6) for t in target.values()}
    assert all(r.taken <= 2 * r["size"] for r in got)
    for s in names:
        taken = sum(r.taken for r in got if round(r.target, 6) == round(target[s], 6) and r.source_size == size[s])
        assert abs(taken - target[s]) <= 16 + 0.02 * target[s]
    assert Counter(map(tuple, mixing.mixed_sizes(docs.repartition(5), block=16).collect())) == Counter(map(tuple, got))
    mixed = Counter()
    for r in mixing.mixed_documents(docs, block=16).collect():
        mixed[r.doc_id] += len(words(r.text))
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert +mixed == +want
    assert mixing.mixed_sizes(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for r in rows():
        ids = library.encode(r[1] or "")
        want[(r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert Counter(map(tuple, pieces.round_trip(docs, path).collect())) == want
    shown = pieces.decoded(pieces.encoded(docs, path), path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, hashlib.sha256(r.text.encode()).hexdigest()) for r in shown) == want
    assert pieces.round_trip(empty, path).count() == 0
    extra = ["  two  spaces ", "\n\n a\n", "def f(x):\n    return x", "Antidisestablishmentarianism interoperability", "żółć Привет", "\0 ab"]
    assert pieces.PieceModel(path).encode(extra) == [np.array(library.encode(t), "<u4").tobytes() for t in extra]


def test_pieces_of_a_unigram_model():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.trainer_spec.model_type = 1
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.7, 1), ("ab", -4.1, 1), ("▁a", -3.9, 1), ("▁ab", -6.3, 1), ("ba", -3.3, 1)]:
        p = spec.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    library, model, rng = SentencePieceProcessor(model_proto=spec.SerializeToString()), pieces.PieceModel.__new__(pieces.PieceModel), random.Random(2)
    model._load(spec)
    texts = ["".join(rng.choice("aabb  c") for _ in range(rng.randrange(1, 12))) for _ in range(1000)]
    assert model.encode(texts) == [np.array(library.encode(t), "<u4").tobytes() for t in texts]


@pytest.fixture(scope="module")
def scored_docs(spark):
    rng = random.Random(9)
    made, marks = [], []
    for i in range(900):
        toxic, good = i % 5 == 0, i % 3 != 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(4)) if rng.random() < 0.7 else rng.choice(["the", "of", "and"]) for _ in range(60)]
        w = w if good else [x + rng.choice(["***", "$$$"]) for x in w]
        if toxic:
            w[rng.randrange(60)] = rng.choice(["idiot,", "Moron"])
        made.append((i, " ".join(w), "en", "s", 0, "a", "b", "c", "d"))
        marks.append((i, int(good), int(toxic)))
    made += [(5000, None, None, None, 0, "", "", "", ""), (5001, "", None, None, 0, "", "", "", ""), (0, made[0][1], None, None, 0, "", "", "", "")]
    return spark.createDataFrame(made, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, column", [(toxicity.toxicity, "toxic"), (quality_classifier.quality, "quality")])
def test_classifiers_on_held_out_rows(scored_docs, empty, score, column):
    docs, labels = scored_docs
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    flat = lambda found: sorted((r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in found)
    assert flat(score(docs.repartition(3), labels).collect()) == flat(got)
    assert score(empty, labels).count() == 0
    few = score(docs.limit(5), labels.where("false")).collect()
    assert len(few) == 5 and all(r.score == 0 for r in few)


def test_labels_of_the_other_fold_alone(scored_docs):
    docs, labels = scored_docs
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b
