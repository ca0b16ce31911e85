"""Byte-pair ids of whole texts by a queue of merges over linked symbols, and texts back from ids.

A text is cut at the strings of special tokens, and at white space. Each word is
lower-cased and split by the tokenizer's pattern; a word with letters beyond U+024F, on
which Unicode versions disagree and which may be composed of several characters, is
normalized and split by the library's own rules. The bytes of a part become symbols,
the last one with the word-end mark. The symbols are a doubly linked list. A priority queue holds the merges of neighbours by
rank, then place; a merge that is taken joins its two symbols, unlinks the right one,
and queues the merges of the new symbol with its neighbours. An entry whose two
symbols are no longer there is stale and skipped, so a word of n bytes takes O(n log n)
steps. Equal parts are merged once, as long as they are remembered.

Ids are decoded by their vocabulary strings, with one space in between, as the library
does it for a tokenizer without a decoder.

Edge cases: a null text is empty; an empty or blank text has no ids and decodes to an
empty text; the strings of special tokens inside a text are these tokens, as with the
library; repeated rows are equal, and rows with a null doc_id are kept; an empty table gives no rows; further columns
are ignored. Caches are bounded and only save time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and parts of words, that a worker remembers; beyond that it keeps the words of the texts at hand, and no parts.
CACHED_WORDS, CACHED_PARTS = 400_000, 800_000
_ROWS = 256
_BEYOND = re.compile("[\u0130\u0250-\U0010ffff]").search
_models: dict[str, MergeModel] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next unused from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeModel:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalized, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, by_bytes = spec["pre_tokenizer"]["pretokenizers"]
        plain = model["type"] == "BPE" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or normal != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or by_bytes["use_regex"] or by_bytes["add_prefix_space"] or spec["decoder"] or any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only byte-pair models of lower-case words, split by a pattern, are supported")
        vocabulary = model["vocab"]
        #: Of each merge by its rank: both symbols and what they become.
        self.lefts, self.rights, self.wholes = ([vocabulary[x] for x in side] for side in zip(*((a, b, a + b) for a, b in model["merges"]), strict=True))
        self.ranks = {pair: rank for rank, pair in reversed([*enumerate(zip(self.lefts, self.rights, strict=True))])}
        letters, end = byte_letters(), model["end_of_word_suffix"] or ""
        self.inner, self.last = [vocabulary[c] for c in letters], [vocabulary[c + end] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        pattern = split["pattern"]["Regex"]
        for kind in (r"\p{L}", r"\p{N}", r"\s"):  # the characters up to U+024F spelled out: re is faster than regex
            pattern = pattern.replace(kind, "".join(re.escape(chr(i)) for i in range(0x250) if regex.match(kind, chr(i))))
        self.parts = re.compile(pattern).findall
        strings = {i: t for t, i in (*vocabulary.items(), *self.special.items())}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.strings))]
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str | bytes, bytes] = {}

    def merged(self, part: bytes) -> list[int]:
        """Ids of one part of a word. A queued merge is its rank, then its place, in one number; the rank tells its two symbols."""
        ids = [*map(self.inner.__getitem__, part[:-1]), self.last[part[-1]]]
        n, find, lefts, rights, wholes = len(ids), self.ranks.get, self.lefts, self.rights, self.wholes
        queue = [rank << 32 | at for at, rank in enumerate(map(find, zip(ids, ids[1:]))) if rank is not None]  # noqa: B905
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids.append(-1)  # a symbol behind the last one, which merges with none
        while queue:
            entry = heappop(queue)
            rank, at = entry >> 32, entry & 0xFFFFFFFF
            gone = after[at]
            if ids[at] != lefts[rank] or ids[gone] != rights[rank]:
                continue  # stale
            whole = ids[at] = wholes[rank]
            ids[gone] = -1
            following = after[at] = after[gone]
            if following < n:
                before[following] = at
                if (rank := find((whole, ids[following]))) is not None:
                    heappush(queue, rank << 32 | at)
            previous = before[at]
            if previous >= 0 and (rank := find((ids[previous], whole))) is not None:
                heappush(queue, rank << 32 | previous)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a word between white space."""
        lower = word.lower()
        if _BEYOND(word) or _BEYOND(lower):
            parts = [bytes(map(self.byte_of.__getitem__, part)) for part, _ in self.split(self.normalized(word))]
        else:
            parts = self.parts(lower)
        known = self.known_parts
        for part in parts:
            if part not in known:
                known[part] = b"".join(map(self.id_bytes.__getitem__, self.merged(part if isinstance(part, bytes) else part.encode())))
        return known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a special token's string is in the list of words as itself."""
        cut = [self._words(t) for t in texts]
        words = set(chain.from_iterable(cut))
        if len(self.known_parts) > CACHED_PARTS:
            self.known_parts.clear()
        if len(self.known) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in words.intersection(self.known)}
        self.known.update((w, self.word(w)) for w in words.difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def _words(self, text: str) -> list[str]:
        if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")):  # white space of str.split, but none of the pattern's
            split = regex.compile(r"[^\s]+").findall
        else:
            split = str.split
        if not any(map(text.__contains__, self.special)):
            return split(text)
        for token, i in self.special.items():
            self.known[token] = np.array([i], "<u4").tobytes()
        return list(chain.from_iterable([x] if x in self.special else split(x) for x in self.cut_special(text)))

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def model_at(path: str) -> MergeModel:
    """One for a worker process: what its earlier tasks have met is known."""
    if path not in _models:
        _models[path] = MergeModel(path)
    return _models[path]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            part = batch.slice(k, _ROWS)
            yield part.column("doc_id"), part.column("text").fill_null("").to_pylist()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every whole text; a pass without a shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for doc_ids, texts in _texts(batches):
            data = model.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4")))], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of every list of ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], "<u4").tobytes()).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, then decoded from its ids."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, digest = model_at(path), lambda x: hashlib.sha256(x).hexdigest()
        for doc_ids, texts in _texts(batches):
            data = model.encode(texts)
            columns = [doc_ids, pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(map(digest, data), pa.string()), pa.array([digest(model.decode(x)) for x in data], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
