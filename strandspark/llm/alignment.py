"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens are linked.

The aligner reads both token rows of a text as a dangling-suffix transducer. Its state
is which side leads, and the bytes by which it leads: the residual. The next token
comes from the other side (from the first, where both are level); it uses up a part of the
residual, or all of it and then leads itself. Transitions are memoised by residual and
token, and an empty residual closes a group. All pairs of a group's tokens are links.
Groups that have been met are numbered, with their text and their pairs.

Texts are cut into spans at spaces and line ends behind other characters, where both
tokenizers begin a new token, so equal spans are encoded and aligned once, as long
as they are remembered. A text's groups, and its distinct pairs with how often each is
linked, are gathered from its spans and written, a row a document.

From that table pairs are counted: first added up within a task, then over all tasks.
How many documents hold a pair is needed back at each of them. Pairs in very many
documents, FREQUENT at most, are sent to all tasks as a table of that bounded size. All other pairs
are joined; as each of these is in few documents, none makes a large partition.

Edge cases: texts that are null or empty, or whose joined token bytes on either side aren't those of
the text behind a space (a text with a mark U+2581), have no tokens: zeros and
an empty string; rows with a null doc_id, or a repeated one, are documents of their own; repeated
rows count as often as they occur; an empty table gives no rows; further columns are
ignored. Caches are bounded and only save time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .merges import byte_letters

#: Most pairs that are sent to all tasks; spans, and open groups, that a worker remembers; texts that are aligned at a time.
FREQUENT, CACHED_SPANS, CACHED_GROUPS, _ROWS = 1 << 17, 500_000, 400_000, 256
#: Characters that are encoded in one call, and pairs that are counted at a time.
_CHARACTERS, _COUNTED = 1 << 15, 1 << 21
#: A span: a space or line end with what follows, up to the next space or line end behind a character that is no white space.
_SPANS = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
#: A span in front of those that begin with a line end, so that a text begins with a space.
MARK, _LETTER = "▁", " x"
#: Steps of a doubling by which pairs are told apart by their counts.
_STEPS = 16
_aligners: dict[tuple[str, str], Aligner] = {}
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_COUNTS = "row long, n_best long, count_sum long, rare array<long>, rare_times array<int>"


class Transducer:
    """States are numbered residuals: the side that leads (0, 1) and its unmatched bytes; state 0 is level."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.bytes_of = (first, second)
        self.residuals: list[tuple[int, bytes]] = [(1, b"")]  # level: as if the second side led, so the first one is next
        self.numbers = {(1, b""): 0}
        self.moves: dict[tuple[int, int], int] = {}

    def move(self, state: int, token: int) -> int:
        """The state after the next token of the side that doesn't lead; -1 if the bytes differ."""
        found = self.moves.get((state, token))
        if found is None:
            leads, rest = self.residuals[state]
            data = self.bytes_of[1 - leads][token]
            if rest.startswith(data):
                after = (leads, rest[len(data) :])
            elif data.startswith(rest):
                after = (1 - leads, data[len(rest) :])
            else:
                after = None
            if after and not after[1]:
                after = (1, b"")
            found = -1 if after is None else self.numbers.setdefault(after, len(self.residuals))
            if found == len(self.residuals):
                self.residuals.append(after)
            self.moves[state, token] = found
        return found


class Groups:
    """Numbered groups, and the open ones that lead to them, each with its residual's state and its tokens so far."""

    def __init__(self, transducer: Transducer, n_second: int):
        self.transducer, self.n_second = transducer, n_second
        self.texts: list[bytes] = []  # of each group: the ids of both sides
        self.sizes = (array("q"), array("q"))
        self.begins, self.pairs, self.times = array("q", [0]), array("q"), array("q")
        self.forget()

    def forget(self) -> None:
        """Open groups are found again; numbered ones stay while spans refer to them."""
        self.side, self.state, self.tokens = [0], [0], [((), ())]
        self.after: dict[int, int] = {}  # by open group << 32 | token: an open group, or ~ the number of a closed one

    def _grown(self, node: int, token: int) -> int | None:
        state = self.transducer.move(self.state[node], token)
        if state < 0:
            return None
        first, second = self.tokens[node]
        tokens = (first, (*second, token)) if self.side[node] else ((*first, token), second)
        if state:
            found = len(self.side)
            self.side.append(1 - self.transducer.residuals[state][0])
            self.state.append(state)
            self.tokens.append(tokens)
        else:
            found = ~len(self.texts)
            self.texts.append("|".join(",".join(map(str, side)) for side in tokens).encode())
            for sizes, side in zip(self.sizes, tokens, strict=True):
                sizes.append(len(side))
            many = Counter(tokens[1]).items()
            for p, k in Counter(tokens[0]).items():
                for q, m in many:
                    self.pairs.append(p * self.n_second + q)
                    self.times.append(k * m)
            self.begins.append(len(self.pairs))
        self.after[node << 32 | token] = found
        return found

    def closed(self, first: list[int], second: list[int]) -> list[int] | None:
        """Numbers of the groups of two rows of tokens; None if their bytes differ, or one side has some left."""
        node, i, j, out, side, after = 0, 0, 0, [], self.side, self.after
        first, second = [*first, -1], [*second, -1]
        while True:
            if side[node]:
                token = second[j]
                j += 1
            else:
                token = first[i]
                i += 1
            if token < 0:
                break
            found = after.get(node << 32 | token)
            if found is None and (found := self._grown(node, token)) is None:
                return None
            if found < 0:
                out.append(~found)
                node = 0
            else:
                node = found
        # at the end, level, the first side's end has been read
        return out if node == 0 and second[j] < 0 else None


class Aligner:
    """Both tokenizers, and each known span's groups."""

    def __init__(self, first_path: str, second_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first_path)
        self.first.encode_special_tokens = True
        with open(first_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        first = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            first[i] = bytes(map(byte_of.__getitem__, token))
        self.second = sentencepiece.SentencePieceProcessor(model_file=second_path)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        second = [bytes([int(p[1:-1], 16)]) if self.second.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece reaches over a mark or a line end")
        if len(first) * len(second) >= 1 << 47:
            raise ValueError("the vocabularies are too large")
        self.lengths = tuple(np.array([len(x) for x in side]) for side in (first, second))
        self.transducer = Transducer(first, second)
        self.forget()

    def forget(self) -> None:
        self.spans: dict[str, int] = {}
        self.groups = Groups(self.transducer, len(self.lengths[1]))
        self.begins, self.members = array("q", [0]), array("q")  # the groups of each span

    def full(self) -> bool:
        return len(self.spans) > CACHED_SPANS

    def _cut(self, ids, side: int, ends: np.ndarray) -> list[list[int]] | None:
        """The tokens of one encoded text, span by span; None if a token reaches over a span's end or the bytes' number differs."""
        at = np.cumsum(self.lengths[side][np.asarray(ids, np.int64)])
        places = np.searchsorted(at, ends)
        if not len(at) or at[-1] != ends[-1] or (at[places] != ends).any():
            return None
        ids, begin, out = list(ids), 0, []
        for end in (places + 1).tolist():
            out.append(ids[begin:end])
            begin = end
        return out

    def _encoded(self, spans: list[str]) -> Iterator[tuple[str, list[int] | None, list[int] | None]]:
        """Spans are encoded many at a time, as one text, and one by one where that text's bytes are others."""
        text = "".join(spans)
        ends = np.cumsum([len(s.encode()) for s in spans])
        # the model puts a mark in front of any text, for which the first span lends its space
        a = self._cut(self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids, 0, ends)
        b = self._cut(self.second.encode(text[1:], num_threads=1) or [self.second.piece_to_id(MARK)], 1, ends) if text[0] == " " else None
        if a is not None and b is not None:
            yield from zip(spans, a, b, strict=True)
        elif len(spans) == 1:
            yield spans[0], a, b
        elif len(spans) == 2 and spans[0] == _LETTER:
            yield from self._encoded([_LETTER])
            yield spans[1], None, None
        else:
            for span in spans:
                yield from self._encoded([span] if span[0] == " " else [_LETTER, span])

    def _learn(self, spans: list[str]) -> None:
        spans.sort(key=lambda s: s[0] != " ")  # those behind spaces first
        k = 0
        while k < len(spans):
            n, size = k, 0
            while n < len(spans) and (n == k or size < _CHARACTERS):
                size += len(spans[n])
                n += 1
            part = spans[k:n] if spans[k][0] == " " else [_LETTER, *spans[k:n]]
            for span, a, b in self._encoded(part):
                found = None if a is None or b is None else self.groups.closed(a, b)
                if span in self.spans:
                    continue
                self.spans[span] = len(self.begins) - 1
                self.members.extend([-1] if found is None else found)
                self.begins.append(len(self.members))
            if len(self.groups.after) > CACHED_GROUPS:
                self.groups.forget()
            k = n

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups, n_links (a row each) and the digest; then its distinct pairs in order, with the text's number and how often each is linked."""
        cut = [_SPANS.findall(" " + t) if t and MARK not in t else [] for t in texts]
        if unseen := set(chain.from_iterable(cut)).difference(self.spans):
            self._learn(list(unseen))
        numbers, held = np.fromiter(map(self.spans.__getitem__, chain.from_iterable(cut)), np.int64), self.groups
        view = lambda x: np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64)
        group, n = _gathered(numbers, view(self.begins), view(self.members))
        text = np.repeat(np.repeat(np.arange(len(texts)), [len(c) for c in cut]), n)
        if (group < 0).any():  # a span whose bytes differ: the text has no tokens
            good = ~np.isin(text, text[group < 0])
            group, text = group[good], text[good]
        pair, m = _gathered(group, view(held.begins), view(held.pairs))
        times, _ = _gathered(group, view(held.begins), view(held.times))
        of = np.repeat(text, m)
        key, inverse = np.unique(of << 47 | pair, return_inverse=True)
        total = np.bincount(inverse, weights=times, minlength=len(key)).astype(np.int64)
        count = lambda at, weights=None: np.bincount(at, weights, minlength=len(texts)).astype(np.int64)
        sizes = np.stack([*(count(text, view(x)[group]) for x in held.sizes), count(text), count(of, times)])
        get, ends = held.texts.__getitem__, np.cumsum(sizes[2]).tolist()
        group = group.tolist()
        digests = [hashlib.sha256(b";".join(map(get, group[a:b]))).hexdigest() if b > a else "" for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return sizes, digests, key >> 47, key & ((1 << 47) - 1), total


def _gathered(rows: np.ndarray, begins: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each row, one after the other, and how many each has."""
    n = begins[rows + 1] - begins[rows]
    return values[np.repeat(begins[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def aligner_at(first_path: str, second_path: str) -> Aligner:
    """One for a worker process: what its earlier tasks have met is known."""
    if (first_path, second_path) not in _aligners:
        _aligners[first_path, second_path] = Aligner(first_path, second_path)
    return _aligners[first_path, second_path]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            part = batch.slice(k, _ROWS)
            yield part.column("doc_id"), part.column("text").fill_null("").to_pylist()


def _lists(counts: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _aligned(first_path: str, second_path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_at(first_path, second_path)
        for doc_ids, texts in _texts(batches):
            if aligner.full():
                aligner.forget()
            sizes, digests, text, pairs, times = aligner.align(texts)
            n = np.bincount(text, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, sizes), pa.array(digests, pa.string()), _lists(n, pairs, pa.int64()), _lists(n, times, pa.int32())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return rows


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    at = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[at[0] : at[-1]].astype(np.int64), np.diff(at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair and n, the documents that hold it, of a task's rows; combined over some millions of pairs at a time."""
    held, n = (np.empty(0, np.int64), np.empty(0, np.int64)), 0
    waiting: list[np.ndarray] = []

    def added() -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.unique(np.concatenate([*waiting, np.empty(0, np.int64)]), return_counts=True)
        both, inverse = np.unique(np.concatenate([held[0], values]), return_inverse=True)
        return both, np.bincount(inverse, weights=np.concatenate([held[1], counts]), minlength=len(both)).astype(np.int64)

    def rows(pairs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], ["pair", "n"])

    for batch in batches:
        waiting.append(_flat(batch.column("pairs"))[0])
        n += len(waiting[-1])
        if n > _COUNTED:
            held, waiting, n = added(), [], 0
            if len(held[0]) > _COUNTED:
                yield from rows(*held)
                held = (np.empty(0, np.int64), np.empty(0, np.int64))
    yield from rows(*added())


def _described(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """n_best and count_sum of each document from the frequent pairs; its other pairs, and how often they are linked, are in two lists. ``pairs`` ascends."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4 * _ROWS):
                part = batch.slice(k, 4 * _ROWS)
                keys, n = _flat(part.column("pairs"))
                times, _ = _flat(part.column("times"))
                row = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
                known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
                sums = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
                for out, of in zip(sums, (best, counts), strict=True):
                    np.add.at(out, row[known], times[known] * of[at[known]])
                rare = np.bincount(row[~known], minlength=len(n))
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, sums), _lists(rare, keys[~known], pa.int64()), _lists(rare, times[~known], pa.int32())], ["row", "n_best", "count_sum", "rare", "rare_times"])

    return described


def alignments(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """A table of row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (first id * size of the second vocabulary + second id) and times."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_aligned(first_path, second_path), _ALIGNED)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "alignments")


def pair_counts(rows: DataFrame, n_second: int) -> DataFrame:
    """pair, n (the documents that hold it linked) and best: 1 if no pair of its first id is in more, else 0. A table."""
    found = rows.select("pairs").mapInArrow(_counted, "pair long, n long")
    counts = written(found.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts").withColumn("a", F.floor(F.col("pair") / n_second))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return written(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "best-pairs")


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the greatest counts, at most ``most``, and all others; pairs whose counts are nearly equal stay together."""
    of = F.floor(F.log2("n") * _STEPS).cast("long")
    steps = counts.groupBy(of.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect()  # at most 64 doublings
    least, total = 64 * _STEPS, 0
    for step in steps:
        total += step.n
        if total > most:
            break
        least = step.step
    return counts.where(of >= least), counts.where(of < least)


def aligned(docs: DataFrame, first_path: str, second_path: str, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    import sentencepiece

    rows = alignments(docs, first_path, second_path)
    counts = pair_counts(rows, sentencepiece.SentencePieceProcessor(model_file=second_path).get_piece_size())
    frequent, rest = _frequent(counts, most)
    found = frequent.toPandas().sort_values("pair")  # at most ``most`` rows
    known = (found[c].to_numpy(np.int64) for c in ("pair", "n", "best"))
    some = written(rows.select("row", "pairs", "times").mapInArrow(_described(*known), _COUNTS), "frequent-counts")
    each = some.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), "x.rare_times")
    more = each.join(rest, "pair").select("row", (F.col("rare_times") * F.col("best")).alias("n_best"), (F.col("rare_times") * F.col("n")).alias("count_sum"))
    sums = some.select("row", "n_best", "count_sum").unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
