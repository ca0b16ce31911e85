"""Objects under stable keys: commits, failed tasks, reruns."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from strandspark.sources import objects


def _rows(spark, texts):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "key string, json string").repartition(3)


def _held(spark, path):
    return {r.key: json.loads(r.json) for r in objects.current_objects(spark, path).collect()}


def test_a_rerun_overwrites_and_history_goes(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    assert _held(spark, path) == {}
    first = {f"repo/{r}/issues/{n}": [r, n] for r in "ab" for n in range(20)} | {"odd/ü ?*": 1, "": 2}
    objects.put_objects(_rows(spark, first), path)
    assert _held(spark, path) == first
    objects.put_objects(_rows(spark, {"repo/a/issues/3": "new", "repo/c/issues/1": None}), path)
    now = first | {"repo/a/issues/3": "new", "repo/c/issues/1": None}
    assert _held(spark, path) == now
    objects.put_objects(_rows(spark, first).limit(0), path)
    assert _held(spark, path) == now
    assert objects.vacuum(spark, path) == 1 and objects.vacuum(spark, path) == 0 and _held(spark, path) == now


def test_a_failed_task_leaves_nothing_to_see(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    objects.put_objects(_rows(spark, {"a": 1}), path)
    rows = spark.range(0, 60, 1, 3).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.when(F.col("id") < 55, "1").otherwise(F.raise_error(F.lit("broken row"))).alias("json"))
    with pytest.raises(Exception, match="broken row"):
        objects.put_objects(rows, path)
    assert glob.glob(f"{tmp_path}/o/objects/k*/*") and _held(spark, path) == {"a": 1}
    assert objects.vacuum(spark, path) > 0 and _held(spark, path) == {"a": 1}
    for bad in (spark.createDataFrame([(None, "1")], "key string, json string"), spark.createDataFrame([("x", "1"), ("x", "2")], "key string, json string").coalesce(1)):
        with pytest.raises(Exception, match="null or repeated key"):
            objects.put_objects(bad, path)
    assert _held(spark, path) == {"a": 1}
