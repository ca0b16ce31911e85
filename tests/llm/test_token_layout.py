"""The layout of the token files, hot rows, and what the encoder does where its cut isn't the library's."""

import re
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq

from strandspark.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_footers(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('word', (id * x) % 97))) AS text")
    token_files.write_token_files(docs, PATH, f"file://{tmp_path}/t", shards=3)
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    assert len(files) == 3
    for path in files:
        meta = pq.ParquetFile(path).metadata
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["shard_start"].encodings
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and columns["ids.list.element"].compression == "ZSTD"
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert all(meta.row_group(i).total_byte_size <= 2 * token_files.ROW_GROUP_BYTES for i in range(meta.num_row_groups))


def test_equal_rows_are_split(spark, tmp_path):
    docs = spark.range(600).selectExpr("CASE WHEN id < 400 THEN 7 ELSE id END AS doc_id", "CASE WHEN id < 400 THEN 'same text' ELSE concat('text ', id) END AS text").repartition(4)
    token_files.write_token_files(docs, PATH, f"file://{tmp_path}/t", shards=4)
    rows = token_files.token_digests(spark, f"file://{tmp_path}/t").collect()
    assert len(rows) == 600 and max(Counter(r.shard for r in token_files.read_token_files(spark, f"file://{tmp_path}/t").select("shard").collect()).values()) < 250
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order)


def test_metadata_is_read_without_ids(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([(i, "some words") for i in range(50)], "doc_id long, text string"), PATH, f"file://{tmp_path}/t", shards=2)
    plan = token_files.read_token_files(spark, f"file://{tmp_path}/t").where("doc_id = 9").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<doc_id:bigint,n_tokens:bigint>", plan) and "EqualTo(doc_id,9)" in plan


def test_a_cut_that_disagrees_is_not_used(monkeypatch):
    assert token_files.WordEncoder(PATH).parts
    monkeypatch.setattr(token_files.WordEncoder, "_cut", lambda self, text: text.lower().split())
    encoder = token_files.WordEncoder(PATH)
    assert encoder.parts is None and encoder.encode(["it's, so"]) == [encoder._by_library("it's, so")]


def test_shards_follow_the_bytes_of_the_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert token_files.shards_for(docs) == least
    assert token_files.shards_for(docs, 10_000) > 20 * least / 4
