"""Queries against their SQL on tables that many partitions hold, with partitions that differ in bytes from side to side."""

from __future__ import annotations

import os

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from waymark import catalog
from waymark.sources import images

catalog.load()
needs_tables = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")
SMALL = {
    "spark.sql.shuffle.partitions": "12", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def repeated(folder, times: int, **keys: str) -> str:
    """The test tables, those named repeated with shifted keys."""
    for t in oracle.TABLES:
        if t not in keys:
            os.symlink(f"{oracle.DATA}/{t}.parquet", f"{folder}/{t}.parquet")
    for t, key in keys.items():
        c = duckdb.connect()
        c.sql(f"create table t as select * from '{oracle.DATA}/{t}.parquet'")
        c.sql(f"copy (select t.* replace ({key} + i * (select max({key}) + 1 from t) as {key}) from t, range({times}) r(i)) to '{folder}/{t}.parquet' (format parquet)")
    return str(folder)


def same(spark, name: str, folder: str) -> None:
    oracle.assert_same(catalog.QUERIES[name](spark, folder), catalog.ORACLES[name], folder)


def test_numbers_are_dense_where_rows_have_many_bytes(spark, small_partitions):
    df = spark.range(20000).select(F.col("id").alias("path"), F.sha2(F.col("id").cast("string"), 512).alias("t"))
    rows = images.numbered(df).collect()
    assert sorted(r.image_id for r in rows) == list(range(20000)) and all(r.path == r.image_id and len(r.t) == 128 for r in rows)


@needs_tables
def test_caption_explode(spark, small_partitions, tmp_path):
    same(spark, "caption_explode", repeated(tmp_path, 60, conversations="conv_id"))


@needs_tables
def test_annotations_retrieval(spark, small_partitions, tmp_path):
    same(spark, "annotations_retrieval", repeated(tmp_path, 60, conversations="conv_id"))


@needs_tables
def test_annotations_video(spark, small_partitions, tmp_path):
    same(spark, "annotations_video", repeated(tmp_path, 60, conversations="conv_id"))


@needs_tables
def test_manifest(spark, small_partitions, tmp_path):
    same(spark, "manifest", repeated(tmp_path, 60, events="event_id"))


@needs_tables
def test_union_db_queries(spark, small_partitions, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")  # ranges are merged down to the parallelism, which a union divides
    same(spark, "union_db_queries", repeated(tmp_path, 20, orders="o_orderkey", customer="c_custkey"))
