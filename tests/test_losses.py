from __future__ import annotations

import os

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from waymark import catalog
from waymark.catalog import relations as R
from waymark.functions import vectors
from waymark.operators import losses


def test_cosface_logits_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [2.0, 4.0], 1), (2, [0.0, 0.0], None), (3, None, 1), (4, [1.0, None], 2), (5, [], 1), (6, [1.0, 2.0, 3.0], 1), (7, [None, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (10, [1e-9, 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    got = losses.cosface_logits(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "db_id"), digits=6).collect()
    con = duckdb.connect()
    con.sql("create table v (id bigint, embedding float[], label int)")
    con.executemany("insert into v values (?, ?, ?)", rows)
    both, size = R.SQL_DOT.format(a="q.embedding", b="d.embedding"), lambda x: R.SQL_NORM.format(a=f"{x}.embedding")
    want = con.sql(f"""WITH c AS (SELECT q.id AS i, d.id AS j, q.label = d.label AS same, {both} / greatest({size("q")} * {size("d")}, 1e-8) AS c FROM v q, v d)
        SELECT i, j, round(c, 6), round(30.0 * (c - CASE WHEN same THEN 0.4 ELSE 0.0 END), 6) FROM c""").fetchall()
    plain = lambda r: tuple(None if x is None else str(x) for x in r)
    assert sorted(map(plain, got)) == sorted(map(plain, want)) and len(got) == len(rows) ** 2


def test_cosface_logits_are_spread_over_tasks_and_take_no_row_as_a_whole(spark):
    df = spark.range(1500).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k)).alias("embedding"), (F.col("id") % 7).alias("label")).coalesce(1)
    q = df.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    out = losses.cosface_logits(q, df.withColumnRenamed("id", "db_id"))
    assert out.select("query_id", "db_id").distinct().count() == out.count() == 30 * 1500
    assert out.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    want = q.select("query_id", F.col("embedding").alias("a"), F.col("label").alias("la")).crossJoin(df.select(F.col("id").alias("db_id"), F.col("embedding").alias("b"), F.col("label").alias("lb")))
    cos = vectors.cosine_clamped(F.col("a"), F.col("b"))
    want = want.select("query_id", "db_id", cos.alias("c"), vectors.cosface(cos, F.col("la") == F.col("lb")).alias("l"))
    assert out.join(want, ["query_id", "db_id"]).where("cosine = c AND logit = l").count() == 30 * 1500


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")
def test_the_query_runs_on_every_core(spark):
    catalog.load()
    out = catalog.QUERIES["cosface_logits"](spark, oracle.DATA)
    assert out.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
