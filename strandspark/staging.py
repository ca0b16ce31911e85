"""Tables in the folder that driver and executors share: intermediate results from which later steps restart."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_noting: list[list[str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a temporary folder is used by a driver that runs its
    tasks itself, as in tests; on a cluster it would be another folder on each machine,
    so there its absence is an error. The caller removes the folder once the result has
    been consumed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="strandspark-")
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for folders in _noting:
        folders.append(folder)
    return folder


@contextmanager
def noted_folders(into: list[str]) -> Iterator[None]:
    """Notes the folders that operators make meanwhile."""
    _noting.append(into)
    try:
        yield
    finally:
        _noting.pop()


def remove_folders(spark: SparkSession, folders: list[str], needed: DataFrame) -> None:
    """Removes the noted folders, except those that ``needed`` is read from."""
    files = needed.inputFiles()
    for folder in [f for f in folders if not any(f.rsplit("/", 1)[-1] in x for x in files)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        folders.remove(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def united(frames: list[DataFrame], name: str) -> DataFrame:
    """The rows of frames of like columns as a table.

    Spark 4.1 plans what follows a union of frames that are dealt by one key without a shuffle; where one
    of them is also read elsewhere in the plan, the union then runs undealt, and a key's rows are two groups. A table is dealt anew.
    """
    return written(reduce(DataFrame.unionByName, frames), name)


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where a scan of few row groups would keep a costly expression on few of them; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
