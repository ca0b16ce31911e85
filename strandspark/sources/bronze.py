"""Raw JSON in and out: whole-object and line files, archives with digests, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.quality import checks


def numbered_lines(lines: DataFrame) -> DataFrame:
    """value, path and line, from 1, of a text scan.

    Within a piece of a file the scan's rows are in order, so a line's number is its
    distance from the piece's first row, after the lines of the file's earlier pieces,
    which are a row each. No text is moved.
    """
    at = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    pieces = at.groupBy("path", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("base"))
    return at.join(pieces, ["path", "start"]).select("value", "path", (F.col("row") + F.col("base")).alias("line"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """json, path and line (from 1) of .json files, an object each, and .jsonl files, an object a line.

    Blank lines are numbered and skipped. Lines are split by Spark's text source, so
    large .jsonl files are read in parallel.
    """
    whole = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(path)
    one = whole.select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("path"), F.lit(1).cast("long").alias("line"))
    many = numbered_lines(lines).select(F.col("value").alias("json"), "path", "line")
    return one.unionByName(many).where(F.trim("json") != "")


def split_malformed(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that hold a JSON object, and the rest."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("json")).startswith("OBJECT"), F.lit(False))
    return objects.where(is_object), objects.where(~is_object)


def bronze_report(objects: DataFrame, name: str = "bronze") -> DataFrame:
    """The raw layer's checks: no objects or malformed ones are hard failures, objects that are no threads are warnings."""
    kind = F.schema_of_variant(F.try_parse_json("json"))
    thread = F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), "$.issue", "variant"))
    return checks(
        objects.select(kind.alias("kind"), thread.alias("thread")), name,
        {"records": ("info", F.count(F.lit(1))), "empty": ("hard", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)), "malformed": ("hard", F.count_if(F.col("kind").isNull())),
         "rejected": ("warning", F.count_if(F.col("kind").isNotNull() & ~F.coalesce(F.col("thread").startswith("OBJECT"), F.lit(False))))},
    )


def write_objects(df: DataFrame, path: str, partition: str, keys: tuple[str, ...] = (), order: str | None = None) -> None:
    """Objects as JSON lines, a folder for each partition value; existing partitions are replaced.

    With ``keys`` the last row of each key, by ``order``, is written: a later fetch of an
    object wins over an earlier one.
    """
    if keys:
        rest = [c for c in df.columns if c not in keys]
        df = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("r")).select(*keys, "r.*").select(*df.columns)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).json(path)


def write_manifest(counts: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's counts, a row a source and one of their totals, as JSON lines."""
    numbers = [f.name for f in counts.schema.fields if f.dataType.typeName() in ("long", "integer")]
    keys = [c for c in counts.columns if c not in numbers]
    totals = counts.agg(*[F.sum(c).alias(c) for c in numbers]).select(*[F.lit(None).cast("string").alias(c) for c in keys], *numbers, F.lit(True).alias("is_total"))
    rows = counts.withColumn("is_total", F.lit(False)).select(*keys, *numbers, "is_total").unionByName(totals)
    rows.select(F.lit(run_id).alias("run_id"), "*").coalesce(1).write.mode("append").json(path)


def write_archive(df: DataFrame, path: str) -> DataFrame:
    """gzip JSON lines; returns the manifest read back: file, bytes, sha256.

    The archive is read again and compared as a bag of rows, by count and by an
    order-free sum of their hashes; a difference is an error.
    """
    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    sums = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)"))).first())
    if sums(lines) != sums(df.sparkSession.read.text(path)):
        raise ValueError(f"{path}: the archive doesn't hold the rows that were written")
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_review(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets, with a header and the mark by which they know UTF-8."""
    first = df.columns[0]
    df.coalesce(1).withColumnRenamed(first, "\ufeff" + first).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, title: str, most: int = 200) -> None:
    """A report of at most ``most`` rows as JSON and as a Markdown table, below one folder."""
    rows = df.limit(most).collect()
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
    df.limit(most).coalesce(1).write.mode("overwrite").json(f"{path}/json")


def not_landed(wanted: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: keys that aren't there yet."""
    return wanted.join(landed.select(*keys).distinct(), keys, "left_anti")
