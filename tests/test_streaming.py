from __future__ import annotations

from pyspark.sql import functions as F

from waymark.streaming import streams


def source(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("meter"), F.col("id").cast("double").alias("value"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    return df, streams.files(spark, str(tmp_path / "in"), "ts timestamp, meter string, value double", 2)


def run(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return query_df.sparkSession.table(name)


def test_persisted(spark, tmp_path):
    df, s = source(spark, tmp_path)
    streams.persisted(s, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select(df.columns).exceptAll(df).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_windows_equal_batch(spark, tmp_path):
    df, s = source(spark, tmp_path)
    got = run(streams.windowed_meters(s, late="10 days"), "w1", "complete").collect()
    want = df.groupBy("meter", F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.count("*").alias("n")).select("meter", F.col("w.start").alias("start"), "avg", "max", "n").collect()
    assert sorted(got) == sorted(want)


def test_sessions(spark, tmp_path):
    _, s = source(spark, tmp_path)
    rows = run(streams.sessions(s, "30 minutes", "10 days"), "w2", "complete").collect()
    assert sorted((r.meter, r.n) for r in rows) == [("a", 50), ("b", 50)]


def test_ring_buffer(spark, tmp_path):
    _, s = source(spark, tmp_path)
    rows = run(streams.ring_buffer(s, 5), "w3", "update").groupBy("meter").agg(F.max("n").alias("n")).collect()
    assert sorted((r.meter, r.n) for r in rows) == [("a", 50), ("b", 50)]


def test_searched(spark, tmp_path):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, embedding array<float>")
    q.write.parquet(str(tmp_path / "q"))
    db = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.1, 1.0])], "db_id long, embedding array<float>")
    s = streams.files(spark, str(tmp_path / "q"), "query_id long, embedding array<float>")
    streams.searched(s, db, 1, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r.query_id, r.db_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (1, 1)]


def test_ring_buffer_keeps_the_last_by_time(spark, tmp_path):
    n = 25_000  # one micro-batch, several frames
    spark.range(n).select(((F.col("id") * 7919) % n).alias("ts"), F.lit("a").alias("meter"), ((F.col("id") * 7919) % n).cast("double").alias("value")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.files(spark, str(tmp_path / "in"), "ts long, meter string, value double")
    row = run(streams.ring_buffer(s, 10), "w4", "update").first()
    assert (row.n, row.total, row.latest) == (n, float(sum(range(n - 10, n))), float(n - 1))
