"""What the training-data operators share: input columns, word rule, shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import noted_folders, remove_folders, shared_folder, written

__all__ = ["DOCUMENT_COLUMNS", "SEPARATORS", "SEPARATOR_RUN", "noted_folders", "remove_folders", "shared_folder", "table", "words_of", "written"]

#: Word separators: space and U+0009 to U+000D; everything else belongs to a word.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
#: Columns of the documents table, which every pipeline stage but the last returns.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR_RUN))
