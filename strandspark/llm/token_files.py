"""Token ids as Parquet list columns that allow selective reads.

Documents are split by range over (doc_id, text hash), sorted, encoded, and written
one file a task: a delta-encoded doc_id, counts and offsets, and the ids as a
dictionary-encoded list. Files are in ascending doc_id order by their shard number,
row groups and pages have a set size, and Parquet's page indexes on the sorted
doc_id let a reader of some documents skip the pages of all others. Reading counts
touches no id.

Edge cases: a null text is empty and has the end id alone; rows with a null doc_id
come first; repeated doc_ids are kept, in the order of their text's hash, and equal
rows may be in several shards; an empty table gives no rows; further columns are ignored. The cache is bounded and
only saves time. The end id and the special tokens' strings inside a text are
encoded as the library does it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder

#: Bytes of a row group before compression, and of a page.
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10
#: Bytes of the input's files, as Spark estimates them, for a shard.
SHARD_BYTES = 128 << 20
#: An estimate without statistics is beyond any size.
_UNKNOWN = 1 << 56
#: Parts of words that a worker remembers; beyond that it starts anew.
CACHED_PARTS = 1_000_000
SHARD_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
_BEYOND = re.compile("[\u0130\u0250-\U0010ffff]").search
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts; equal parts of texts are encoded once.

    Where the tokenizer's own file says that it drops white space, lower-cases, and
    splits by a pattern, a text is cut into the pattern's parts, and the library
    encodes all unseen parts in one text, with spaces between: a part's last token is
    the one that ends with the word-end mark. Texts with letters beyond U+024F, whose
    normal form may depend on neighbours, and texts that may hold a special token are
    encoded by the library as a whole. With any other kind of tokenizer all are, and also
    where the cut disagrees with the library on any character that it may meet.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.known = None, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = lambda x, inner: (x or {}).get(inner) or [x or {}]
        split = [x for x in steps(spec["pre_tokenizer"], "pretokenizers") if x.get("type") == "Split" and x["behavior"] == "Removed" and x["invert"] and "Regex" in x["pattern"]]
        shapes = {x.get("type") for x in steps(spec["normalizer"], "normalizers")}
        if len(split) == 1 and shapes == {"NFC", "Replace", "Lowercase"} and spec["model"].get("end_of_word_suffix"):
            pattern = split[0]["pattern"]["Regex"]
            self.parts = regex.compile(pattern).findall
            for kind in (r"\p{L}", r"\p{N}", r"\s"):  # the first 256 characters spelled out: re is faster than regex
                pattern = pattern.replace(kind, "".join(re.escape(chr(i)) for i in range(256) if regex.match(kind, chr(i))))
            self.latin_parts = re.compile(pattern).findall
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
            if not self._agrees():
                self.parts = None

    def _agrees(self) -> bool:
        """Whether every character that texts are cut at by pattern is cut as by the library, among letters, digits, marks and itself."""
        texts = [f"a{c}b {c}{c} 1{c}2 .{c}. it{c}s'{c}" for c in map(chr, range(0x250)) if not _BEYOND(c)]
        try:
            return self.encode(texts) == [self._by_library(t) for t in texts]
        except (KeyError, ValueError):  # a part that the library splits, or drops
            return False

    def _by_library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        for k in range(0, len(parts), 4096):
            some = parts[k : k + 4096]
            data = self._by_library(" ".join(some))
            ends = (4 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1)).tolist()
            self.known.update(zip(some, (data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))

    def _cut(self, text: str) -> list[str] | None:
        if "<|" in text:
            return None
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return None if _BEYOND(text) else self.parts(text.lower())
        return self.latin_parts(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self._cut(t) if self.parts else None for t in texts]
        if len(self.known) > CACHED_PARTS:
            self.known.clear()
        if unseen := set(chain.from_iterable(c for c in cut if c)).difference(self.known):
            self._learn(list(unseen))
        get = self.known.__getitem__
        return [self._by_library(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


def encoder_of(path: str) -> WordEncoder:
    """One for a worker process: what its earlier tasks have met is known."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _shards(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = encoder_of(path), 0
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column("text").fill_null("").to_pylist()
                data = [x + end for x in encoder.encode(texts)]
                n = np.array([len(x) // 4 for x in data], np.int64)
                ends = start + np.cumsum(n)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("shard"), pa.array(ends - n), pa.array(n), ids], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                start = int(ends[-1])

    return encode


def shards_for(docs: DataFrame, most_bytes: int = SHARD_BYTES) -> int:
    """As many as the bytes of the input's files ask for, and no fewer than the session's partitions, which are all where Spark knows no bytes."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most_bytes) if size < _UNKNOWN else 1)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, shards: int | None = None) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the shards below ``folder``.

    The one shuffle moves the texts to their range; encoding and writing follow in
    the same task, so a lost executor repeats single shards. The ranges are also by the
    text's hash and the row's number, so copies under one doc_id are split as well.
    """
    spark = docs.sparkSession
    shards = shards or shards_for(docs)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ranged = ranged.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "row").drop("row")
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("shard", F.spark_partition_id())
    encoded = ranged.mapInArrow(_shards(tokenizer_path, end_id), SHARD_SCHEMA)
    writer = encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    # v2 writes longs with DELTA_BINARY_PACKED where the dictionary is off; ids keep their dictionary
    writer.option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#shard_start", "false").option("parquet.enable.dictionary#ids.list.element", "true").option("parquet.dictionary.page.size", 1 << 20).parquet(folder)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, at = np.asarray(lists.values, "<i4"), np.asarray(lists.offsets)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "shard", "shard_start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, shard_start, n_tokens, ids of every document; Spark reads the columns that are used."""
    return spark.read.schema(SHARD_SCHEMA).parquet(folder)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files.

    A shard's ids in front of it are a running sum over one row a shard, read from
    two small columns; the ids column is read only for the checksum.
    """
    sizes = read_token_files(spark, folder).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shards
    bases = sizes.select(F.col("shard").alias("of_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = read_token_files(spark, folder).mapInArrow(_crc, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    rows = rows.join(bases, F.col("shard") == F.col("of_shard"))
    return rows.select("doc_id", (F.col("base") + F.col("shard_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the files into the shared folder and returns what is read back from them."""
    folder = shared_folder(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, folder, end_id)
    return token_digests(docs.sparkSession, folder)
