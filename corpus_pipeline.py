"""The corpus pipeline: five operators in a row, each over all that the one before kept.

A stage first removes the folders that the stages before have left, except those that
its own input is read from.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm import mixing, pieces, quality_rules, simhash, substring_dedup
from strandspark.llm.common import DOCUMENT_COLUMNS, noted_folders, remove_folders, table, written

_left: list[str] = []


def tidy(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_folders(spark, _left, docs)
        with noted_folders(_left):
            return stage(spark, docs, sf_dir)

    return run_stage


@tidy
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go."""
    return quality_rules.without_rejected(docs, table(spark, sf_dir, "labels"), DOCUMENT_COLUMNS)


@tidy
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row of least (doc_id, text hash) stays, once; documents without id stay."""
    docs = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("text").alias("text_hash"))
    found = simhash.near_duplicates(docs, ("text_hash",), with_root=True)
    # an id with unrelated texts heads several groups; of a group's rows under its smallest id, those with the least text hash; equal rows are one
    first = found.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    kept = docs.join(first, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*DOCUMENT_COLUMNS)


@tidy
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; documents of which nothing is left go."""
    found = substring_dedup.without_repeats(docs, ("lang", "source")).where("n_removed = 0 OR n_removed < n_words")
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document, or a part of it, is in the mix."""
    return mixing.mixed_documents(docs).select(*DOCUMENT_COLUMNS)


@tidy
def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids' number and checksum, and the digest of the text decoded from them."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed),
    ("pieces", as_pieces),
]

#: DuckDB has neither XXH64 nor the models' encoding; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
