"""Near-duplicates by SimHash fingerprints, found with fuzzy keys from the Golay code.

A fingerprint's 64 bits are three segments of 23, 23 and 18 bits. Two fingerprints
that differ in at most four bits have two segments that differ in at most two bits
together. The perfect binary Golay code of length 23 maps each segment to the one
codeword within three bits; a segment that is off by e bits lies within 3 + e of
that codeword. So for each pair of segments one side is filed under its two
codewords, and the other side looks under all pairs of codewords within (4, 4),
(5, own) and (own, 5) bits: no two fingerprints within four bits miss each other.
Candidates are verified inside the join; pairs that already share a group aren't
returned.

Edge cases: null and blank texts have fingerprint zero, linked like any other;
texts of fewer words than a shingle are one shingle; rows with a null doc_id have a
fingerprint and link others, and their component is the smallest id in it, null if
there is none; repeated rows are equal; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import least_of_component

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: First bit and number of bits of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = tuple(combinations(range(3), 2))
#: Generator polynomial of the binary Golay code of length 23: x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
_CHUNK = 1 << 15


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the shingles' XXH64 values."""
    words = text.lower().split()  # bytes: only A-Z is lowered, and only ASCII white space splits
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) if len(words) >= width else [b" ".join(words)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(shingles), _CHUNK):
        part = shingles[k : k + _CHUNK]
        hashes = np.fromiter((digest(x, SEED) for x in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(shingles), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            found = np.array([simhash(t) for t in part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()], np.uint64)
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found.view(np.int64))], [*names, "bits"])


@cache
def golay_keys() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each radius r: error patterns of weight <= r by syndrome, least weight first, and where a syndrome's begin."""
    out = {}
    for radius in (3, 4, 5):
        patterns = np.array([sum(1 << i for i in c) for w in range(radius + 1) for c in combinations(range(23), w)], np.int64)
        s = syndrome(patterns)
        order = np.argsort(s, kind="stable")
        out[radius] = (patterns[order], np.searchsorted(s[order], np.arange(2049)))
    return out


def syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for i in range(22, 10, -1):
        v ^= np.where(v >> i & 1, GOLAY << (i - 11), 0)
    return v


def codewords(v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and codeword index (its 12 upper bits) of all codewords within ``radius`` of each v."""
    patterns, begin = golay_keys()[radius]
    s = syndrome(v)
    n = begin[s + 1] - begin[s]
    row = np.repeat(np.arange(len(v)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[s], n)
    return row, (v[row] ^ patterns[at]) >> 11


def _segments(bits: np.ndarray) -> list[np.ndarray]:
    return [(bits >> np.uint64(first) & np.uint64((1 << n) - 1)).astype(np.int64) for first, n in SEGMENTS]


def filed_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key: three a fingerprint."""
    own = [codewords(s, 3)[1] for s in _segments(bits)]
    keys = [(p << 24) | (own[x] << 12) | own[y] for p, (x, y) in enumerate(PAIRS)]
    return np.tile(np.arange(len(bits)), 3), np.concatenate(keys)


def sought_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every place where a fingerprint within four bits may be filed."""
    segments = _segments(bits)
    own = [codewords(s, 3)[1] for s in segments]
    near = [codewords(s, 4) for s in segments]
    far = []
    for s, o in zip(segments, own, strict=True):
        row, word = codewords(s, 5)
        four = set(zip(*(x.tolist() for x in codewords(s, 4)), strict=True))
        keep = np.fromiter(((r, w) not in four for r, w in zip(row.tolist(), word.tolist(), strict=True)), bool, len(row)) if len(row) else np.zeros(0, bool)
        far.append((row[keep], word[keep]))
    rows, keys = [], []
    for p, (x, y) in enumerate(PAIRS):
        (rx, wx), (ry, wy) = near[x], near[y]
        ny = np.bincount(ry, minlength=len(bits))
        begin = np.cumsum(ny) - ny
        n = ny[rx]
        row = np.repeat(rx, n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[rx], n)
        rows += [row, far[x][0], far[y][0]]
        keys += [(p << 24) | (np.repeat(wx, n) << 12) | wy[at], (p << 24) | (far[x][1] << 12) | own[y][far[x][0]], (p << 24) | (own[x][far[y][0]] << 12) | far[y][1]]
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(keys_of):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                row, key = keys_of(part.column("bits").to_numpy().view(np.uint64))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), part.column("bits").take(take), part.column("grp").take(take)], ["key", "bits", "grp"])

    return keyed


_KEYED = "key int, bits long, grp long"


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry`` of docs and bits, the fingerprint as a signed long, of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"c_{c}") for c in carry], F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(_fingerprints, f"{schema}, bits long")


def near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def grouped(bits: DataFrame) -> DataFrame:
    """``bits`` (distinct fingerprints) with grp: the least fingerprint, within four bits, of the places where it is filed.

    Fingerprints with one grp are connected through it, so a dense group of near
    copies needs no links among its members.
    """
    filed = bits.select("bits", F.lit(0).cast("long").alias("grp")).mapInArrow(_keyed(filed_keys), _KEYED).select("key", "bits")
    least = written(filed.groupBy("key").agg(F.min("bits").alias("least")), "least-filed")
    return filed.join(least, "key").groupBy("bits").agg(F.coalesce(F.min(F.when(near("bits", "least"), F.col("least"))), F.col("bits")).alias("grp"))


def links(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of grp that have fingerprints within four bits of each other.

    The side with three rows a fingerprint is hashed; the other, of some 180, streams
    past it. The bits are compared in the join's condition.
    """
    filed = groups.mapInArrow(_keyed(filed_keys), _KEYED).select(F.col("key").alias("k"), F.col("bits").alias("x"), F.col("grp").alias("a"))
    sought = groups.mapInArrow(_keyed(sought_keys), _KEYED).select("key", F.col("bits").alias("y"), F.col("grp").alias("b"))
    found = sought.join(filed.hint("shuffle_hash"), (F.col("k") == F.col("key")) & (F.col("x") < F.col("y")) & (F.col("a") != F.col("b")) & near("x", "y"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = (), with_root: bool = False) -> DataFrame:
    """doc_id, ``carry``, fingerprint and component_id of every document.

    A doc_id that repeats with unrelated texts gives several components one id; their
    root, the least fingerprint of a component as a long, tells them apart.

    Equal fingerprints are one node; fingerprints, groups and edges are tables in the
    shared folder, so a lost executor costs single tasks of the step that runs.
    """
    marked = written(fingerprints(docs, carry), "fingerprints")
    nodes = marked.groupBy("bits").agg(F.min("doc_id").alias("first"))
    groups = written(grouped(nodes.select("bits")), "groups")
    edges = links(groups).unionByName(groups.where("bits != grp").select(F.col("bits").alias("a"), F.col("grp").alias("b")))
    roots = least_of_component(edges)
    rooted = nodes.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "first", F.coalesce("least", "bits").alias("root"))
    ids = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")  # a large component's rows can then be split
    of_bits = rooted.join(ids, "root").select(F.col("bits").alias("of_bits"), "component_id", "root")
    out = marked.join(of_bits, F.col("bits") == F.col("of_bits"))
    return out.select("doc_id", *[F.col(f"c_{c}").alias(c) for c in carry], F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", *(["root"] if with_root else []))
