"""One run from raw objects to embedded chunks: clean, chunk and embed what changed, with a gate before each layer is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, cleaning, models
from ..operators.quality import checks, duplicates, require_pass
from ..operators.tables import KeyedTable, changed_or_pending
from ..sources.bronze import bronze_report
from ..staging import written
from .incremental import advanced

THREAD, CHUNK = ("repository", "issue_number"), ("repository", "issue_number", "chunk_type", "chunk_index")


def silver_gate(threads: DataFrame) -> DataFrame:
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    return checks(threads, "silver", {"duplicate_threads": ("hard", duplicates(*THREAD)), "blank_keys": ("hard", blank("repository") + blank("issue_number")), "blank_hashes": ("hard", blank("content_hash"))})


def gold_gate(chunks: DataFrame, threads: DataFrame, dimensions: int) -> DataFrame:
    """Chunks without a vector of the right size or without text, keys twice, and threads with text that have no chunk."""
    spoken = chunking.thread_sources(threads).select(*THREAD).distinct()
    own = checks(chunks, "gold", {
        "bad_vectors": ("hard", F.count_if(F.col("embedding").isNull() | (F.size("embedding") != dimensions))), "blank_texts": ("hard", F.count_if(F.trim("chunk_text") == "")), "duplicate_chunks": ("hard", duplicates(*CHUNK)),
    })
    return own.unionByName(checks(spoken.join(chunks.select(*THREAD), list(THREAD), "left_anti"), "gold", {"threads_without_chunks": ("hard", F.count(F.lit(1)))}))


def run_layers(raw: DataFrame, silver: KeyedTable, gold: KeyedTable, marks: KeyedTable, factory: Callable[[], models.Embedder], dimensions: int, tokenizer: Callable[[], chunking.Tokenizer] = chunking.words) -> dict[str, int]:
    """What a run did with raw objects (repository, seq, json): how many were rejected, stored, chunked anew, embedded.

    Each gate stands before its layer is written, and the watermarks, the latest
    change of each repository, come last; so a run that fails anywhere is run again from the same watermarks, and
    what it had already written is met as unchanged. Only threads whose content hash isn't that of their chunks are
    chunked; their chunks are replaced as a whole, and a chunk of equal id and text keeps its vector. No objects: nothing is done.
    """
    raw = written(raw.select("repository", "seq", "json"), "raw-objects")
    if not raw.limit(1).count():
        return dict.fromkeys(("rejected", "stored", "chunked", "embedded"), 0)
    require_pass(bronze_report(raw))
    good, bad = cleaning.clean_threads(raw)
    good = written(good.drop("seq"), "good-threads")
    require_pass(silver_gate(good))
    silver.upsert(good)
    held = gold.touched(good) if gold.read() is not None else None
    threads = good.withColumnRenamed("content_hash", "hash")
    if held is None:
        work = good
    else:
        reasons = changed_or_pending(threads, held.select(*THREAD, F.col("content_hash").alias("hash"), F.col("embedding").alias("payload")), THREAD)
        work = written(good.join(reasons.select(*THREAD), list(THREAD), "left_semi"), "changed-threads")
    chunks = chunking.thread_chunks(work, tokenizer=tokenizer)
    if held is not None:
        known = held.select(F.col("chunk_id").alias("_id"), F.col("chunk_text").alias("_text"), "embedding")
        chunks = chunks.join(known, (F.col("chunk_id") == F.col("_id")) & (F.col("chunk_text") == F.col("_text")), "left").drop("_id", "_text")
    else:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    chunks = written(chunks, "chunks")
    new = written(models.embedded(chunks.where("embedding IS NULL").select(F.col("chunk_id").alias("id"), F.col("chunk_text").alias("text")), factory, dimensions), "embedded")
    whole = chunks.join(new.select(F.col("id").alias("_id"), F.col("embedding").alias("_new")), F.col("chunk_id") == F.col("_id"), "left")
    whole = written(whole.withColumn("embedding", F.coalesce("embedding", "_new")).drop("_id", "_new"), "gold-rows")
    require_pass(gold_gate(whole, work, dimensions))
    gold.replace(work.select(*THREAD), whole)
    seen = good.groupBy(F.col("repository").alias("key")).agg(F.max("updated_at").alias("watermark")).where("watermark IS NOT NULL")
    before = marks.read()
    marks.upsert(seen if before is None else advanced(before, seen))
    return {"rejected": bad.count(), "stored": good.count(), "chunked": work.count(), "embedded": new.count()}
