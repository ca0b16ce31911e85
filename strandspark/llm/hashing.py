"""Word and window hashes of many texts at once, in numpy.

Sums of value * base**position modulo 2**64 give the polynomial hash of any span by
one subtraction and one multiplication with the base's inverse power, so all words
of a text, and all windows of words, are hashed without a Python loop (Rabin-Karp
over prefix sums). Word hashes are scrambled before windows are summed over them.
"""

from __future__ import annotations

import numpy as np

#: Class of each byte: 0 separates, a run of one other class is a word.
WORDS = np.ones(256, np.int8)
WORDS[[9, 10, 11, 12, 13, 32]] = 0
#: The same with ASCII punctuation as a class of its own.
WORDS_AND_MARKS = WORDS.copy()
WORDS_AND_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_PIECE = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**n and their inverses modulo 2**64."""
    held = _tables.get(base)
    if held is None or len(held[0]) <= n:
        n = max(n + 1, 1 << 16)
        tables = []
        for x in (base, pow(base, -1, 1 << 64)):
            t = np.empty(n + 1, np.uint64)
            t[0] = 1
            np.multiply.accumulate(np.full(n, x, np.uint64), out=t[1:])
            tables.append(t)
        held = (tables[0], tables[1])
        if n <= 4 * _PIECE:
            _tables[base] = held
    return held


def scrambled(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(text: np.ndarray, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of UTF-8 bytes."""
    kind = np.zeros(len(text) + 2, np.int8)
    kind[1:-1] = classes[text]
    change = kind[1:] != kind[:-1]
    return np.flatnonzero(change & (kind[1:] != 0)), np.flatnonzero(change & (kind[:-1] != 0))


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of a buffer, whose starts and ends both ascend."""
    hashes, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):  # pieces bound the power tables; a piece ends with a span
        a = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, a + _PIECE, "right")))
        piece = buffer[a : ends[to - 1]]
        up, down = powers(_BYTE_BASE, len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        s, e = starts[k:to] - a, ends[k:to] - a
        hashes[k:to] = scrambled((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        k = to
    return hashes


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each with a separator behind it, and where each begins, the buffer's end last."""
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), begins


def word_hashes(texts: list[bytes], classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    buffer, begins = joined(texts)
    starts, ends = word_spans(buffer, classes)
    return span_hashes(buffer, starts, ends), np.diff(np.searchsorted(starts, begins))


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    values = scrambled(words, salt) if salt else words
    out = np.empty(n, np.uint64)
    for a in range(0, n, _PIECE):
        b = min(n, a + _PIECE)
        part = values[a : b + width - 1]
        up, down = powers(_WORD_BASE, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[a:b] = scrambled((sums[width:] - sums[:-width]) * down[: b - a], salt)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[: len(x) - (width - span)], x[width - span :])
