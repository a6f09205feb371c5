"""Recall, rank metrics, meters, accuracy and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors


def recall_at(queries: DataFrame, predictions: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(k, recall) in percent of all queries, those without positives included.

    queries: (query_id); predictions: (query_id, rank, db_id); positives: (query_id, db_id)."""
    hits = predictions.join(positives.select("query_id", "db_id").distinct(), ["query_id", "db_id"], "left_semi")
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first"))
    wide = queries.select("query_id").join(first, "query_id", "left").agg(*[(100.0 * F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)))).alias(str(k)) for k in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("recall")) for k in ks])).alias("x")).select("x.k", "x.recall")


def positive_ranks(scores: DataFrame, positives: DataFrame, query: str, item: str) -> DataFrame:
    """(query, rank): the best place, from 0, of a positive among all of a query's scores; ties go to the higher id."""
    w = W.partitionBy(query).orderBy(F.desc("score"), F.desc(item))
    ranked = scores.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
    return ranked.join(positives.select(query, item).distinct(), [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("rank"))


def rank_metrics(ranks: DataFrame, prefix: str, median: bool = False) -> DataFrame:
    """One row: r1, r5, r10 in percent and their mean; the median of rank + 1, interpolated, if asked for."""
    r = [(100.0 * F.avg((F.col("rank") < k).cast("int"))).alias(f"{prefix}_r{k}") for k in (1, 5, 10)]
    out = ranks.agg(*r, *([F.median(F.col("rank") + 1).alias(f"{prefix}_mdR")] if median else []))
    return out.withColumn(f"{prefix}_r_mean", sum(F.col(f"{prefix}_r{k}") for k in (1, 5, 10)) / 3)


def matching_eval(i2t: DataFrame, t2i: DataFrame, image_texts: DataFrame, median: bool = False) -> DataFrame:
    """Both directions: i2t and t2i are (img_id, txt_id, score), image_texts (img_id, txt_id)."""
    t = rank_metrics(positive_ranks(i2t, image_texts, "img_id", "txt_id"), "txt")
    v = rank_metrics(positive_ranks(t2i, image_texts, "txt_id", "img_id"), "img", median)
    return t.crossJoin(v).withColumn("r_mean", (F.col("txt_r_mean") + F.col("img_r_mean")) / 2)


def report(predictions: DataFrame, positives: DataFrame) -> DataFrame:
    """(query_id, preds, correct, positives): ordered predictions with their flags, and the positives' ids."""
    flagged = predictions.join(positives.select("query_id", "db_id", F.lit(True).alias("_ok")).distinct(), ["query_id", "db_id"], "left")
    rows = flagged.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "db_id", F.coalesce("_ok", F.lit(False)).alias("ok")))).alias("l"))
    known = positives.groupBy("query_id").agg(F.sort_array(F.collect_set("db_id")).alias("positives"))
    out = rows.join(known, "query_id", "left")
    return out.select("query_id", F.transform("l", lambda x: x["db_id"]).alias("preds"), F.transform("l", lambda x: x["ok"]).alias("correct"), F.coalesce("positives", F.array().cast("array<bigint>")).alias("positives"))


def wrong_only(reports: DataFrame) -> DataFrame:
    """Reports whose first prediction is wrong."""
    return reports.where(~F.get("correct", F.lit(0)))


def accuracy(df: DataFrame, logits: str, label: str, batch: str) -> DataFrame:
    """One row: the mean of the batches' accuracies, weighted by their sizes."""
    hit = (vectors.argmax(F.col(logits)) == F.col(label)).cast("double")
    per = df.groupBy(batch).agg(F.avg(hit).alias("acc"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("accuracy"))


def smoothed(meters: DataFrame, window: int = 20) -> DataFrame:
    """Each step with the median (the lower of two), mean, maximum and latest of the last values, and the running average.

    meters: (meter, step, value, n)."""
    last = W.partitionBy("meter").orderBy("step").rowsBetween(-(window - 1), 0)
    run = W.partitionBy("meter").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    values = F.sort_array(F.collect_list("value").over(last))
    return meters.select(
        "meter", "step",
        F.element_at(values, (F.floor((F.size(values) - 1) / 2) + 1).cast("int")).alias("median"),
        F.avg("value").over(last).alias("avg"), F.max("value").over(last).alias("max"), F.last("value").over(last).alias("latest"),
        (F.sum(F.col("value") * F.col("n")).over(run) / F.sum("n").over(run)).alias("global_avg"),
    )


def global_average(meters: DataFrame) -> DataFrame:
    """(meter, total, count, global_avg): summed in each task, then over tasks."""
    return meters.groupBy("meter").agg(F.sum(F.col("value") * F.col("n")).alias("total"), F.sum("n").alias("count")).withColumn("global_avg", F.col("total") / F.col("count"))


def eta(steps: DataFrame, total: int) -> DataFrame:
    """(run, step, iter_time, eta, elapsed) of (run, step, ts): seconds of a step, those left at the running mean, and those gone."""
    w = W.partitionBy("run").orderBy("step")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    took = t - F.lag(t).over(w)
    out = steps.withColumn("iter_time", took)
    mean = F.avg("iter_time").over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.select("run", "step", "iter_time", (mean * (F.lit(total) - F.col("step"))).alias("eta"), (t - F.min(t).over(W.partitionBy("run"))).alias("elapsed"))


def ring_buffer(rows: DataFrame, order: str, size: int) -> DataFrame:
    """The rows that a buffer of size slots holds at the end, with their slots: the last size rows."""
    n = rows.count()
    last = rows.orderBy(F.desc(order)).limit(size)  # each task keeps its last; the window is over size rows
    return last.withColumn("slot", F.pmod(F.lit(n) - F.row_number().over(W.orderBy(F.desc(order))), F.lit(size)).cast("int"))


def histogram(df: DataFrame, value: str, group: str, bins: int = 30) -> DataFrame:
    """(group, bin, count): equal bins over each group's range, the last one closed; nulls and NaN take no part."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(group).alias("g"), F.col(value).alias("v"))
    span = v.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return v.join(F.broadcast(span), "g").groupBy(F.col("g").alias(group), at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def five_numbers(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, mean, q1, median, q3, low, high): whiskers end at the outermost values within 1.5 quartile ranges."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(group), F.col(value).alias("v"))
    q = v.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(group, "n", "mean", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = v.join(F.broadcast(q), group).where(F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)).groupBy(group).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return q.join(ends, group)


def processing_stats(results: DataFrame) -> DataFrame:
    """One row over (query_id, failed, n_matches): total, successful and failed queries, and matches."""
    failed = F.coalesce("failed", F.lit(False)).cast("long")
    return results.agg(F.count(F.lit(1)).alias("total_queries"), F.sum(1 - failed).alias("successful_queries"), F.sum(failed).alias("failed_queries"), F.sum(F.coalesce("n_matches", F.lit(0))).cast("long").alias("total_retrievals"))


def summed_scores(parts: DataFrame) -> DataFrame:
    """(i, j, score): scores of several processes added up; missing entries are no candidates and stay missing."""
    return parts.groupBy("i", "j").agg(F.sum("score").alias("score"))


def throughput(images: Column, seconds: Column) -> Column:
    """struct(sec_per_image, images_per_sec)."""
    return F.struct(F.try_divide(seconds, images).alias("sec_per_image"), F.try_divide(images, seconds).alias("images_per_sec"))
