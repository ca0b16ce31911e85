"""An object a row, under a stable key: a data source whose commits decide what a reader sees.

Tasks write each object to a file of its own below its key, and a list of what they wrote.
Only the driver's commit, one small file that names the lists of the tasks that
succeeded, makes these objects visible, all at once; of several commits the latest
one has each key. A task that fails, or whose work is done twice, leaves files that
no list of a commit names. A rerun overwrites, as its commit is later.

The driver handles a name a task, never one an object.

Edge cases: keys are any text and may hold slashes; a null key, or a key that one task writes twice, is an error; of
a key that several tasks of one write have, the greatest file name counts, so a write's
keys should be unique; an empty write commits nothing new.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class KeyedObjects(DataSource):
    """``format("keyed_objects")``: option path, a URI or absolute path that all machines reach; columns key and json."""

    @classmethod
    def name(cls) -> str:
        return "keyed_objects"

    def schema(self) -> str:
        return "key string, json string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [f.name for f in schema.fields])


class _Message(WriterCommitMessage):
    def __init__(self, listed: str, n: int):
        self.listed, self.n = listed, n


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(system, path: str, data: bytes) -> None:
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        if not {"key", "json"} <= set(columns):
            raise ValueError("the rows need the columns key and json")
        self.path, self.run = path, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        (system, root), task, listed = _opened(self.path), uuid.uuid4().hex, {}
        for row in rows:
            if row.key is None or row.key in listed:
                raise ValueError(f"a null or repeated key: {row.key}")
            listed[row.key] = f"objects/{quote(row.key, safe='/').strip('/') or '_'}/{self.run}-{task[:8]}.json"
            _put(system, f"{root}/{listed[row.key]}", (row.json or "null").encode())
        name = f"lists/{self.run}/{task}.jsonl"
        _put(system, f"{root}/{name}", "".join(json.dumps({"key": k, "file": f}) + "\n" for k, f in listed.items()).encode())
        return _Message(name, len(listed))

    def commit(self, messages: list) -> None:
        system, root = _opened(self.path)
        done = [m for m in messages if m is not None and m.n]
        _put(system, f"{root}/commits/_{self.run}", json.dumps({"run": self.run, "lists": [m.listed for m in done], "n": sum(m.n for m in done)}).encode())
        system.move(f"{root}/commits/_{self.run}", f"{root}/commits/{self.run}.json")  # hidden until it is whole

    def abort(self, messages: list) -> None:
        """Nothing is visible; ``vacuum`` removes what is left."""


def put_objects(df: DataFrame, path: str) -> None:
    """Writes key and json of each row and commits them together."""
    df.sparkSession.dataSource.register(KeyedObjects)
    df.select(F.col("key").cast("string").alias("key"), F.col("json").cast("string").alias("json")).write.format("keyed_objects").option("path", path).mode("append").save()


def _committed(spark: SparkSession, path: str) -> DataFrame:
    """key and file of every object that a commit names, and the commit's run."""
    from pyarrow import fs

    system, root = _opened(path)
    if system.get_file_info(f"{root}/commits").type == fs.FileType.NotFound:
        return spark.createDataFrame([], "key string, file string, run string")
    commits = spark.read.schema("run string, lists array<string>, n long").json(f"{path.rstrip('/')}/commits").select("run", F.explode("lists").alias("listed"))
    rows = spark.read.schema("key string, file string").option("recursiveFileLookup", True).json(f"{path.rstrip('/')}/lists").select("key", "file", F.regexp_extract(F.col("_metadata.file_path"), "(lists/[^/]+/[^/]+)$", 1).alias("listed"))
    return rows.join(commits, "listed").select("key", "file", "run")


def current_objects(spark: SparkSession, path: str) -> DataFrame:
    """key, json and run of the latest committed object of each key; tasks read the files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _opened(path)
        for frame in frames:
            texts = []
            for file in frame.file:
                with system.open_input_stream(f"{root}/{file}") as data:
                    texts.append(data.read().decode())
            yield pd.DataFrame({"key": frame.key, "json": texts, "run": frame.run})

    latest = _committed(spark, path).groupBy("key").agg(F.max(F.struct("run", "file")).alias("x")).select("key", "x.file", "x.run")
    return latest.mapInPandas(read, "key string, json string, run string")


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes object files that are not the latest of a key, those of failed tasks included; for use while nobody writes. How many went."""
    held = _committed(spark, path).groupBy("key").agg(F.max(F.struct("run", "file")).alias("x")).select("x.file")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path.rstrip('/')}/objects").select(F.regexp_extract("path", "(objects/.*)$", 1).alias("file"))

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _opened(path)
        for frame in frames:
            for file in frame.file:
                system.delete_file(f"{root}/{file}")
            yield pd.DataFrame({"n": [len(frame)]})

    return files.join(held, "file", "left_anti").mapInPandas(remove, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
