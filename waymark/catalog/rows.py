"""Text functions, annotation rows, JSON, joins by key, result merging, meters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths, text
from ..operators import lookup, metrics
from ..sources import annotations, sinks, tables
from ..streaming import streams
from . import query
from . import relations as R


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents")


@query(
    r"""WITH c AS (SELECT doc_id, trim(rtrim(regexp_replace(regexp_replace(lower(text), '[.!"()*#:;~]', ' ', 'g'), '\s{2,}', ' ', 'g'), chr(10)), ' ') AS c FROM documents)
SELECT doc_id, array_to_string(list_slice(string_split(c, ' '), 1, 50), ' ') AS caption FROM c"""
)
def caption_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.caption(F.col("text")).alias("caption"))


@query(
    r"""WITH c AS (SELECT doc_id, rtrim(regexp_replace(lower(text), '[.!"()*#:;~]', '', 'g'), ' ') AS c FROM documents)
SELECT doc_id, array_to_string(list_slice(string_split(c, ' '), 1, 50), ' ') AS question FROM c"""
)
def question_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.question(F.col("text")).alias("question"))


@query(
    """SELECT doc_id, CASE WHEN length(text) > 300 THEN CASE WHEN contains(left(text, 300), ' ') THEN regexp_replace(left(text, 300), ' [^ ]*$', '') ELSE left(text, 300) END ELSE text END AS cut_clip,
  CASE WHEN length(text) > 2000 THEN CASE WHEN contains(left(text, 2000), ' ') THEN regexp_replace(left(text, 2000), ' [^ ]*$', '') ELSE left(text, 2000) END ELSE text END AS cut_blip FROM documents"""
)
def truncate_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.cut_at_word(F.col("text"), 300).alias("cut_clip"), text.cut_at_word(F.col("text"), 2000).alias("cut_blip"))


@query(
    """SELECT conv_id, turn, array_to_string(list_transform(string_split('left ' || text || ' right', ' '), lambda w: CASE w WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' ELSE w END), ' ') AS swapped FROM conversations"""
)
def left_right_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.sides_swapped(F.concat(F.lit("left "), F.col("text"), F.lit(" right"))).alias("swapped"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), '|') AS fields FROM documents")
def comma_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.comma_fields(F.col("text")), "|").alias("fields"))


@query("SELECT item_id, 'a picture of ' || text AS prompted, text AS stripped FROM benchmark")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "a picture of "
    with_it = R.table(spark, sf_dir, "benchmark").select("item_id", text.with_prompt(F.col("text"), p).alias("prompted"))
    return with_it.withColumn("stripped", text.without_prompt(F.col("prompted"), p))


@query(
    """WITH c AS (SELECT conv_id, turn, text, dense_rank() OVER (ORDER BY conv_id) - 1 AS img_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS txt_id FROM conversations)
SELECT img_id, txt_id, text FROM c"""
)
def caption_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.text_ids(R.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY first) - 1 AS source_no FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dense_ids(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", "source_no")


@query(
    """WITH d AS (SELECT source AS image_path, arg_min(text, doc_id) AS description FROM documents GROUP BY 1), i AS (SELECT page_id, 'src' || (page_id % 30) AS path FROM pages)
SELECT page_id, path, coalesce(description, '') AS description FROM i LEFT JOIN d ON path = image_path"""
)
def desc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("source").alias("image_path"), F.col("text").alias("description"), "doc_id")
    i = R.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src"), F.col("page_id") % 30).alias("path"))
    return lookup.describe(i, d, ["doc_id"])


@query("SELECT conv_id, role AS answer, round(count(*) / any_value(n), 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY 1, 2")
def vqa_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = R.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("answers"))
    return lookup.answer_weights(lists, "conv_id", "answers").withColumn("weight", F.round("weight", 6))


@query("SELECT text, arg_min(doc_id, (doc_id % 2, doc_id)) AS doc_id FROM documents GROUP BY text")
def merge_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("text", "doc_id", F.col("doc_id").alias("pos"))
    halves = [d.where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    return lookup.merge_keep_first(halves, "text").select("text", "doc_id")


@query(
    """SELECT event_id, 'f/' || event_id || '.jpg' AS image_path, event_type || ', ' || user_id AS description FROM events WHERE event_id % 3 <> 0"""
)
def json_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events")
    uri = F.concat(F.lit("gs://b/p/f/"), F.col("event_id"), F.lit(".jpg"))
    part = F.to_json(F.struct(F.concat(F.col("event_type"), F.lit(", "), F.col("user_id")).alias("text")))
    response = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(',"response":{"candidates":[{"content":{"parts":['), part, F.lit("]}}]}"))).otherwise(F.when(F.col("event_id") % 2 == 0, F.lit(',"response":{"candidates":[]}')).otherwise(F.lit("")))
    line = F.concat(F.regexp_replace(sinks.request(uri, F.lit('say "what"')), r"\}$", ""), response, F.lit("}"))
    parsed = e.select("event_id", F.from_json(line, schema.PREDICTION_LINE).alias("j")).select("event_id", "j.*")
    return tables.prediction_rows(parsed, "gs://b/p/").withColumn("event_id", F.regexp_extract("image_path", r"f/(\d+)", 1).cast("long"))


@query(
    """SELECT page_id, '{"request":{"contents":[{"role":"user","parts":[{"file_data":{"file_uri":"gs://b/' || page_id || '.jpg","mime_type":"image/jpeg"}},{"text":"say \\"what\\""}]}]}}' AS value FROM pages"""
)
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("gs://b/"), F.col("page_id"), F.lit(".jpg"))
    return R.table(spark, sf_dir, "pages").select("page_id", sinks.request(uri, F.lit('say "what"')).alias("value"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events WHERE (props::JSON->>'$.k') IS NOT NULL")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.where("k is not null")


@query("SELECT 'r/' || conv_id || '.jpg' AS image0, 'r/' || turn || '.jpg' AS image1, (role = 'user')::INT AS label FROM conversations")
def nlvr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "conversations")
    name = lambda k: F.concat(F.col(k), F.lit(".jpg"))
    rows = c.select(F.array(name("conv_id"), name("turn")).alias("images"), F.col("text").alias("sentence"), F.when(F.col("role") == "user", "True").otherwise("False").alias("label"))
    return annotations.nlvr_rows(rows, "r").drop("sentence")


@query("SELECT CASE WHEN q % 7 = 0 THEN 'train' WHEN q % 7 = 1 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM (SELECT doc_id AS q FROM documents) GROUP BY 1")
def split_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("doc_id") % 7
    return _docs(spark, sf_dir).groupBy(F.when(q == 0, "train").when(q == 1, "val").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"))


_METERS = "m AS (SELECT event_type AS meter, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value, 1 + event_id % 4 AS n FROM events)"


def _meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = R.table(spark, sf_dir, "events")
    step = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("event_type").alias("meter"), step.alias("step"), "value", (1 + F.col("event_id") % 4).alias("n"))


@query(
    f"""WITH {_METERS}, w AS (SELECT *, list_sort(list(value) OVER f) AS l, avg(value) OVER f AS a, max(value) OVER f AS x,
  sum(value * n) OVER g / sum(n) OVER g AS ga FROM m WINDOW f AS (PARTITION BY meter ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY meter ORDER BY step ROWS UNBOUNDED PRECEDING))
SELECT meter, step, round(l[(len(l) - 1) // 2 + 1], 6) AS median, round(a, 6) AS avg, round(x, 6) AS max, round(value, 6) AS latest, round(ga + 1e-9, 6) AS global_avg FROM w"""
)
def meter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.smoothed(_meters(spark, sf_dir)).select("meter", "step", *[F.round(c, 6).alias(c) for c in ("median", "avg", "max", "latest")], F.round(F.col("global_avg") + 1e-9, 6).alias("global_avg"))


@query(f"WITH {_METERS} SELECT meter, round(sum(value * n), 4) AS total, sum(n)::BIGINT AS count, round(sum(value * n) / sum(n), 6) AS global_avg FROM m GROUP BY 1")
def meter_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.global_average(_meters(spark, sf_dir)).select("meter", F.round("total", 4).alias("total"), "count", F.round("global_avg", 6).alias("global_avg"))


@query(
    """WITH e AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, epoch_us(ts) / 1e6 AS t FROM events),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY step) AS iter_time, t - min(t) OVER (PARTITION BY run) AS elapsed FROM e)
SELECT run, step, round(iter_time, 3) AS iter_time, round(avg(iter_time) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) * (10000 - step), 1) AS eta, round(elapsed, 3) AS elapsed FROM d"""
)
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = R.table(spark, sf_dir, "events")
    step = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    out = metrics.eta(e.select(F.col("event_type").alias("run"), step.alias("step"), "ts"), 10000)
    return out.select("run", "step", F.round("iter_time", 3).alias("iter_time"), F.round("eta", 1).alias("eta"), F.round("elapsed", 3).alias("elapsed"))


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, (i % 576)::INT AS slot FROM r WHERE i >= n - 576")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ring_buffer(R.table(spark, sf_dir, "events").select("event_id"), "event_id", 576)


@query(
    """WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT user_id, list(event_type ORDER BY event_type) AS t FROM r GROUP BY 1)
SELECT user_id % 10 AS batch, string_agg(array_to_string(t, ','), ',' ORDER BY user_id) AS flat, string_agg(len(t), ',' ORDER BY user_id) AS lengths FROM l GROUP BY 1"""
)
def collated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = R.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("answers")).withColumn("batch", F.col("user_id") % 10)
    out = lookup.collated(lists, "batch", "user_id", "answers")
    return out.select("batch", F.array_join("flat", ",").alias("flat"), F.array_join(F.col("lengths").cast("array<string>"), ",").alias("lengths"))


@query(
    """WITH p AS (SELECT query_id, rank FROM (VALUES (1)) x(z), (SELECT vec_id AS query_id FROM embeddings), range(1, 4) t(rank))
SELECT printf('%03d.jpg', query_id) AS name, 'Query path:' || chr(10) || 'q' || query_id || chr(10) || chr(10) || 'Predictions paths:' || chr(10) || 'p1' || chr(10) || 'p2' || chr(10) || 'p3' || chr(10) AS value FROM p GROUP BY query_id"""
)
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.table(spark, sf_dir, "embeddings")
    preds = F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))
    return q.select(paths.report_name(F.col("vec_id")).alias("name"), sinks.report(F.concat(F.lit("q"), F.col("vec_id")), preds).alias("value"))


@query(
    """SELECT event_type AS meter, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 6) AS avg, round(max(value), 6) AS max, count(*) AS n FROM events GROUP BY 1, 2"""
)
def stream_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream, in hourly windows."""
    s = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    windows = streams.windowed_meters(s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("meter"), "value"), late="3650 days")
    name = f"meters_{uuid.uuid4().hex}"
    windows.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("meter", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("avg", 6).alias("avg"), F.round("max", 6).alias("max"), "n")
