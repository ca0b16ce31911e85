"""The training fold, its labels, and bounded samples of documents' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and y of the labelled documents of the training fold; of several labels of a document the greatest."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def least_hashed(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of least hash of doc_id, so a rerun has the same."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``ids`` (distinct doc_id, and more), whose number the caller bounds, with their document's text.

    Of several texts under one id that of least hash is used; ids without a document go.
    """
    rest = [c for c in ids.columns if c != "doc_id"]
    texts = docs.select(F.col("doc_id").cast("long").alias("of_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), F.col("of_doc") == F.col("doc_id"))  # a bounded number of rows of a few numbers
    return found.groupBy("doc_id", *rest).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("doc_id", "text", *rest)


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id, text and y of at most ``most`` labelled documents of the training fold."""
    return texts_of(docs, least_hashed(training_labels(labels, column), most))
