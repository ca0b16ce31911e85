"""WARC archives with a Zstandard dictionary in their leading frame.

A dictionary is built once from a bounded sample of the records to be archived.
Each task writes its partition's records into one archive or more: a skippable
frame that holds the dictionary, then one Zstandard frame a record, so that any
record can be read by its offset. Readers take the dictionary from the file.

Of the records with equal payloads of at least ``least_bytes`` bytes, the one with
the smallest id is a response and the others are revisits of it.

Edge cases: a null payload is empty; payloads below the limit are always responses;
rows that repeat the smallest id of their payload are all responses; a null id
comes after all others: it revisits the smallest id, and a group of null ids has
responses only; a null url is left out of the header; an empty table makes no
archive and reads as no rows. Without samples enough for training, the dictionary
is the sample's raw content. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: Bounds of the training sample: records, and bytes used of each.
SAMPLE_RECORDS, SAMPLE_BYTES = 1_000, 16 << 10
#: Compressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
LEAST_REVISIT_BYTES = 100
#: Tasks that read archives; with more archives a task has several.
MOST_TASKS = 20_000


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit that refers to the response and has no payload."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    named = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {named(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {named(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def trained_dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _archives(folder: str, dictionary: bytes):
    """Writes a partition's archives; yields a row for each, which the caller counts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, n, k = None, 0, 0
        held = f"{root}/.{part}-{attempt}"

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{part:06d}-{k:04d}-{attempt}.warc.zst"
            store.move(held, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "n_records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out, n = store.open_output_stream(held, compression=None), 0
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                out.write(compressor.compress(record(*row)))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()

    return write


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Archives ``pages`` (page_id, url, html) below ``folder``.

    The manifest, a table of archives and record counts, is committed by Spark, so it
    names the archives of the attempts that counted, and no others. Only digests that occur more than once are joined back to the pages, from a
    pre-aggregated table; Spark broadcasts it when small, splits skewed keys if not.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    ids = [x.page_id for x in rows.groupBy("digest").agg(F.min("page_id").alias("page_id")).where("page_id IS NOT NULL").orderBy("digest").limit(SAMPLE_RECORDS).collect()]
    sample = rows.where(F.col("page_id").isin(ids)).select("digest", "page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).dropDuplicates(["page_id", "digest"]).orderBy("digest").limit(SAMPLE_RECORDS)
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("of_digest"), "first")
    first = written(first, "first-pages")  # a table: the join's sides are plain shuffles, and a payload of very many pages is split
    rows = rows.join(first, F.col("digest") == F.col("of_digest"), "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    dictionary = trained_dictionary([record(x.page_id, x.url, bytes(x.payload), x.digest, None) for x in sample.collect()])
    rows.mapInArrow(_archives(folder, dictionary), "archive string, n_records long").write.parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an archive, held one at a time."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no dictionary frame")
    dictionary = stream.read(length)
    text = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).stream_reader(stream, read_across_frames=True, closefd=False)
    held = b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not (more := text.read(1 << 16)):
                if held:
                    raise ValueError("the archive ends within a record")
                return
            held += more
        head = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
        length = int(head["Content-Length"])
        need = [held[end + 4 :]]
        size = len(need[0])
        while size < length + 4:
            need.append(text.read(max(1 << 16, length + 4 - size)))
            if not need[-1]:
                raise ValueError("the archive ends within a record")
            size += len(need[-1])
        rest = b"".join(need)
        yield head, rest[:length]
        held = rest[length + 4 :]


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    number = lambda x: int(x) if x else None
    for batch in batches:
        for name in batch.column("archive").to_pylist():
            rows, size = [], 0
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for head, body in records_of(stream):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
                        raise ValueError(f"{name}: the payload of page {head['X-Page-ID']} doesn't have its digest")
                    rows.append((number(head["X-Page-ID"]), head.get("WARC-Target-URI"), body, int(head["X-Payload-Length"]), digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-ID"))))
                    size += len(body)
                    if len(rows) >= 5_000 or size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of all archives; a response's digest and length are verified.

    Each task streams its share of the manifest's archives record by record.
    """
    archives = spark.read.schema("archive string").parquet(f"{folder}/manifest")
    # a task an archive: they are bounded in size, and a number that is given isn't lessened by the adaptive planner
    archives = archives.repartitionByRange(max(1, min(MOST_TASKS, archives.count())), "archive")
    return archives.mapInArrow(lambda batches: _read(folder, batches), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and authority of the cluster's default file system, where it has none of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


def archived(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes the archives into the shared folder and returns what is read back from them."""
    spark = pages.sparkSession
    folder = qualified(spark, shared_folder(spark, "warc"))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    write_archives(pages, folder, least_bytes)
    return read_archives(spark, folder)
