"""SentencePiece ids by one forward pass over a trie of distinct marked words.

A text's spaces become marks, and no piece reaches from a letter over a mark, so a
text is a row of marked words (a mark, or several, and what follows up to the next),
which are cut further where the vocabulary has no piece that reaches over.
The distinct unseen words of some texts are sorted, and the sorted list is walked as
the depth-first order of their trie: a stack keeps the forward state of every
character of the current word, and the next word goes on from the end of the prefix
that both share.

The forward state is Viterbi's: the best sum of scores of a path to this place, and
its last piece. With a unigram model a path may be any row of pieces. A BPE model's
scores are merge ranks, so its best sum alone wouldn't be the model's own encoding.
There a step of a path from a piece to the next is allowed only if the two, joined,
are merged into just these two again; along such steps only the model's own encoding
of a prefix reaches its end. Either way the ids are those of the library for the same
model, as far as its sums of 32-bit floats over a whole text are exact.

Edge cases: a null text is empty and has no ids; characters that no
piece has become byte pieces, or the unknown id without byte fallback; a mark
character in a text is decoded as a space, as by the library; repeated rows are
equal; an empty table gives no rows; further columns are ignored. Caches are bounded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words between spaces, parts of words, and pairs of pieces, that a worker remembers.
CACHED_WORDS, CACHED_PARTS, CACHED_PAIRS = 400_000, 300_000, 400_000
_ROWS = 256
_models: dict[str, PieceModel] = {}


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        self._load(spec)

    def _load(self, spec) -> None:
        kinds = spec.SentencePiece
        normal = (spec.normalizer_spec.name == "identity" and spec.normalizer_spec.add_dummy_prefix and not spec.normalizer_spec.remove_extra_whitespaces and spec.normalizer_spec.escape_whitespaces)
        if not normal or any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("only models with plain normalization and without user-defined pieces are supported")
        self.unigram = spec.trainer_spec.model_type == spec.trainer_spec.UNIGRAM
        if not self.unigram and any(p.type == kinds.UNUSED for p in spec.pieces):
            raise ValueError("BPE models with unused pieces are not supported")
        self.unknown = spec.trainer_spec.unk_id
        self.pieces = [p.piece for p in spec.pieces]
        self.scores = [p.score for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece reaches over a mark")
        of_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.of_byte = of_byte if len(of_byte) == 256 else None
        least = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.unknown_score = least - 10.0
        #: Trie of the pieces: a node's next nodes by character, and the piece that ends at a node.
        self.next, self.piece_at = [{}], [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.piece_at.append(-1)
            self.piece_at[node] = i
        self.words = re.compile(self._word_pattern()).findall
        self.length = [len(p) for p in self.pieces]
        self.plain = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        #: Ids of words between spaces, of the marked parts of words, and which pieces follow each other.
        self.spaced: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _word_pattern(self) -> str:
        """Marked words, cut also where no piece reaches over: around line ends, and from a letter to a digit or mark of ASCII.

        Which of these no piece has after a letter is found in the vocabulary. What ends a
        run of unknown characters must be known, as such a run is one id.
        """
        after_letters = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        opening = [c for c in map(chr, range(33, 127)) if not c.isalpha() and c not in after_letters and (self.of_byte or c in self.ids)]
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        o = "".join(map(re.escape, opening))
        rest = f"[^{MARK}{alone}{o}]"
        plain = f"{MARK}+{rest}*|{rest}+" if not o else f"(?:{MARK}+[{o}]*|[{o}]+|(?={rest})){rest}*(?:(?<![^\\W\\d_])[{o}]+{rest}*)*"
        return plain + "|\n" * bool(alone)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours merge first, the leftmost on ties."""
        parts, ids, scores = list(text), self.ids, self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, a: int, b: int) -> bool:
        """Whether pieces a and b side by side are encoded as just these; a < 0: b alone."""
        key = (a + 1) << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            p, q = self.pieces[a] if a >= 0 else "", self.pieces[b]
            found = self.pairs[key] = self.merged(p + q) == ([p, q] if p else [q])
        return found

    def learn(self, words: list[str]) -> None:
        """Ids of the words, in one walk over their trie."""
        following, piece_at, length, scores, stays, unigram = self.next, self.piece_at, self.length, self.scores, self.stays, self.unigram
        root, pairs = following[0], self.pairs
        # by depth: score, last piece (-1: none yet, or a character without a piece), its length, open trie nodes with their starts
        best, last, size, open_at = [0.0], [-1], [0], [[]]
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], last[shared + 1 :], size[shared + 1 :], open_at[shared + 1 :]
            for i in range(shared, len(word)):
                c, going = word[i], []
                found, value, width = -1, None, 1
                for start, after in (*open_at[i], (i, root)):
                    node = after.get(c)
                    if node is None:
                        continue
                    if following[node]:
                        going.append((start, following[node]))
                    piece = piece_at[node]
                    if piece < 0:
                        continue
                    if not unigram:
                        # a BPE model allows one step at most; others don't count
                        if value is not None or not pairs.get((last[start] + 1) << 32 | piece, True) or not stays(last[start], piece):
                            continue
                    total = best[start] + scores[piece]
                    if value is None or total > value:
                        found, value, width = piece, total, length[piece]
                if value is None or (unigram and found >= 0 and best[i] + self.unknown_score > value and c not in root):
                    found, value, width = -1, best[i] + self.unknown_score, 1
                best.append(value), last.append(found), size.append(width), open_at.append(going)
            ids, i = [], len(word)
            while i:
                if last[i] >= 0:
                    ids.append(last[i])
                elif self.of_byte:
                    ids += [self.of_byte[b] for b in reversed(word[i - 1].encode())]
                elif i < 2 or last[i - 1] >= 0:  # the unknown id stands for a run of characters
                    ids.append(self.unknown)
                i -= size[i]
            self.known[word] = np.array(ids[::-1], "<u4").tobytes()
            before = word

    def _spaced(self, text: str) -> list[str] | None:
        """A text's words between spaces; those after a run of spaces with all but one of them. None: the text has marks of its own."""
        if MARK in text:
            return None
        words = text.split(" ")
        if "" not in words:
            return words
        out, run = [], 0
        for w in words:
            if w:
                out.append(" " * run + w)
                run = 0
            else:
                run += 1
        return out + [" " * (run - 1)] * (run > 0)

    def _met(self, words: set[str], known: dict[str, bytes], most: int) -> set[str]:
        """Forgets what isn't among ``words``, if too much is known, as these are likely to come again; returns what is new."""
        if len(known) > most:
            kept = {w: known[w] for w in words.intersection(known)}
            known.clear()
            known.update(kept)
        return words.difference(known)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self._spaced(t) if t else [] for t in texts]
        marked = {w: self.words(MARK + w.replace(" ", MARK)) for w in self._met(set(chain.from_iterable(c for c in cut if c)), self.spaced, CACHED_WORDS)}
        whole = {t: self.words(MARK + t.replace(" ", MARK)) for t, c in zip(texts, cut, strict=True) if c is None}
        self.learn(list(self._met(set(chain.from_iterable((*marked.values(), *whole.values()))), self.known, CACHED_PARTS)))
        part = self.known.__getitem__
        self.spaced.update((w, b"".join(map(part, parts))) for w, parts in marked.items())
        get = self.spaced.__getitem__
        return [b"".join(map(part, whole[t]) if c is None else map(get, c)) for t, c in zip(texts, cut, strict=True)]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def model_at(path: str) -> PieceModel:
    """One for a worker process: what its earlier tasks have met is known."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield batch.slice(k, _ROWS)


def _lists(data: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4")))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every whole text; a pass without a shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(model.encode(part.column("text").fill_null("").to_pylist()))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and the decoded text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for part in _slices(batches):
            lists = part.column("ids")
            values, at = np.asarray(lists.values, "<i4"), np.asarray(lists.offsets).tolist()
            data = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array([model.decode(x) for x in data], pa.string())],
                ["doc_id", "n_tokens", "ids_crc32", "text"],
            )

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids_crc32 long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and decoded_sha256 of every document: encoded, then decoded from its ids.

    Both directions share one Python worker a task, and its model.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for part in _slices(batches):
            data = model.encode(part.column("text").fill_null("").to_pylist())
            digests = [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in data]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(both, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
