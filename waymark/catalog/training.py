"""Schedules, accuracy, epochs and summed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import lookup, metrics, reshape
from . import query
from . import relations as R


@query(
    """SELECT e AS epoch, round((1e-4 - 1e-6) * 0.5 * (1 + cos(pi() * e / 20.0)) + 1e-6, 12) AS cosine, round(least(1e-4, 1e-6 + (1e-4 - 1e-6) * e / 10.0), 12) AS warmup,
  round(greatest(1e-6, 1e-4 * pow(0.9, e)), 12) AS step, round(0.4 * least(1.0, e / 8.0), 9) AS alpha FROM (SELECT unnest(range(0, 21)) AS e)"""
)
def lr_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("id")
    return spark.range(21).select(
        e.alias("epoch"), F.round(numbers.cosine_lr(e, 20, 1e-4, 1e-6), 12).alias("cosine"), F.round(numbers.warmup_lr(e, 10, 1e-6, 1e-4), 12).alias("warmup"),
        F.round(numbers.step_lr(e, 1e-4, 1e-6, 0.9), 12).alias("step"), F.round(numbers.ramp(0.4, e, 8), 9).alias("alpha"),
    )


@query(
    """WITH t AS (SELECT vec_id, label, embedding, vec_id % 16 AS b, list_position(list_slice(embedding, 1, 10), list_max(list_slice(embedding, 1, 10))) - 1 = label AS hit FROM embeddings),
p AS (SELECT b, avg(hit::INT) AS acc, count(*) AS n FROM t GROUP BY 1) SELECT round(sum(acc * n) / sum(n), 6) AS accuracy FROM p"""
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 10).alias("logits"), "label", (F.col("vec_id") % 16).alias("batch"))
    return metrics.accuracy(e, "logits", "label", "batch").select(F.round("accuracy", 6).alias("accuracy"))


_EPOCHS = "e AS (SELECT event_id // 100 AS epoch, round(avg(value), 6) AS r_mean FROM events GROUP BY 1)"


@query(
    f"""WITH {_EPOCHS}, w AS (SELECT *, max(r_mean) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT epoch, r_mean, greatest(r_mean, before) AS best, before IS NULL OR r_mean > before AS is_best FROM w"""
)
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("r_mean"))
    return lookup.best_by(e, "epoch", "r_mean")


@query("SELECT user_id AS i, event_id % 50 AS j, round(sum(value), 4) AS score FROM events GROUP BY 1, 2")
def summed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.table(spark, sf_dir, "events").select(F.col("user_id").alias("i"), (F.col("event_id") % 50).alias("j"), F.col("value").alias("score"))
    return metrics.summed_scores(parts).withColumn("score", F.round("score", 4))


@query(
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * (CASE WHEN i = 1 THEN 1.0 ELSE 0.005 END)::DOUBLE * pow(0.995::DOUBLE, n - i)), 6) AS ema FROM s GROUP BY 1"""
)
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events")
    listed = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return listed.select("user_id", F.round(numbers.ema(F.col("v"), 0.995), 6).alias("ema"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(range(0, 8), lambda i: floor(p_partkey % 7 + i * ((100 + p_partkey % 50) / 8.0))::BIGINT), lambda f: f < 60 + p_partkey % 40), ',') AS frames FROM part")
def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    frames = numbers.uniform_frames(k % 7, 60 + k % 40, 100 + k % 50, 8)
    return R.table(spark, sf_dir, "part").select("p_partkey", F.array_join(frames.cast("array<string>"), ",").alias("frames"))


@query("SELECT round(1.0 / (1.0 + exp(value / 100.0)), 9) AS p, event_id FROM events")
def match_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "events").select("event_id", F.round(numbers.match_probability(F.col("value") / 100.0, F.lit(0.0)), 9).alias("p"))


@query(
    """WITH v AS (SELECT label, i AS dim, avg(list_extract(embedding, i)::DOUBLE) AS m, max(list_extract(embedding, i)::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2)
SELECT label, (dim - 1)::INT AS dim, round(m, 6) AS mean, round(x, 6) AS max FROM v"""
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = reshape.pooled(R.table(spark, sf_dir, "embeddings"), "label")
    return pooled.select("label", "dim", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


@query("SELECT 'R@1: ' || printf('%.1f', 100.0 * sum((label = 1)::INT) / count(*)) || ', R@5: ' || printf('%.1f', 100.0 * sum((label <= 5)::INT) / count(*)) AS line FROM embeddings")
def recall_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings").agg(*[(100.0 * F.sum(hit.cast("int")) / F.count(F.lit(1))).alias(n) for n, hit in (("r1", F.col("label") == 1), ("r5", F.col("label") <= 5))])
    return e.select(text.recall_line({1: F.col("r1"), 5: F.col("r5")}).alias("line"))


@query("SELECT p_partkey, printf('%.1f', p_partkey * 12347 / 1000000.0) || 'M' AS params FROM part WHERE p_partkey * 12347 >= 1000000 UNION ALL SELECT p_partkey, printf('%.1f', p_partkey * 12347 / 1000.0) || 'K' FROM part WHERE p_partkey * 12347 < 1000000")
def param_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "part").select("p_partkey", numbers.param_count(F.col("p_partkey") * 12347).alias("params"))
