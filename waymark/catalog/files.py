"""Sources and sinks: tables are written in the shared folder in a format, and read again by its reader."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import reshape
from ..session import scratch
from ..sources import annotations, images, sinks, tables
from ..streaming import streams
from . import geography, query
from . import relations as R


def _described(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    sinks.csv(R.table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".jpg")).alias("image_path"), F.col("text").alias("description")), path)
    return path


@query("SELECT 'd/' || doc_id || '.jpg' AS image_path, text AS description FROM documents")
def description_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.descriptions(spark, _described(spark, sf_dir))


@query("SELECT '/img/d/' || doc_id || '.jpg' AS image_path, text AS description FROM documents")
def description_csv_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.descriptions(spark, _described(spark, sf_dir), "/img")


@query("SELECT 'p' || p_partkey AS image_path, p_name || '; ' || p_brand AS description FROM part")
def descriptions_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no CSV: the description holds the delimiter, unquoted."""
    path = scratch(spark)
    p = R.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(";'"), "p_name", F.lit("; "), "p_brand", F.lit("'")).alias("image_path;description"))
    p.write.options(header=True, sep="\x01", quote="").csv(path)
    return tables.descriptions_by_hand(spark, path)


@query(f"SELECT * REPLACE (query_id::VARCHAR AS query_id) FROM ({geography.GEO_TOPK_WIDE})")
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.csv(geography.geo_topk_wide(spark, sf_dir), path)
    return tables.results(spark, path)


@query("SELECT CASE item_id % 7 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, 'i' || item_id AS image_path, text AS description FROM benchmark")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description file for each split."""
    folder, out = scratch(spark), None
    b, k = R.table(spark, sf_dir, "benchmark"), F.col("item_id") % 7
    for name, rows in (("train", k == 0), ("val", k == 1), ("test", k > 1)):
        sinks.csv(b.where(rows).select(F.concat(F.lit("i"), "item_id").alias("image_path"), F.col("text").alias("description")), f"{folder}/{name}.csv", single=True)
        part = tables.descriptions(spark, f"{folder}/{name}.csv").withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_type || '|' || user_id AS fields FROM events WHERE event_id % 3 <> 0")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    line = F.when(F.col("event_id") % 3 != 0, F.concat("event_type", F.lit(", "), "user_id")).otherwise(F.when(F.col("event_id") % 2 == 0, "  ").otherwise(""))
    R.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return tables.split_lines(spark, path).select(F.array_join("fields", "|").alias("fields"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS image_id, '/data/e/' || event_id || '.jpg' AS path FROM events QUALIFY event_id % 5 <> 0")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing in many files with blank lines, in the order of their names."""
    path = scratch(spark)
    line = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("e/"), "event_id", F.lit(".jpg"))).otherwise("")
    R.table(spark, sf_dir, "events").orderBy("event_id").select(line.alias("value")).write.text(path)
    return images.manifest(spark, path, "/data")


_ENDINGS = ("jpg", "JPG", "jpeg", "png", "bmp", "webp", "txt")
_SQL_FILE = "(CASE WHEN n_nationkey % 3 = 0 THEN 'sub/' ELSE '' END) || n_nationkey || '.' || (['" + "','".join(_ENDINGS) + "'])[n_nationkey % 7 + 1]"


@query(
    f"""WITH f AS (SELECT {_SQL_FILE} AS path FROM nation)
SELECT 'common' AS way, path FROM f WHERE regexp_matches(lower(path), '[.](jpg|jpeg|png)$') UNION ALL SELECT 'six', path FROM f WHERE NOT path LIKE '%.txt'
UNION ALL SELECT 'cased', path FROM f WHERE path LIKE '%.jpg' UNION ALL SELECT 'flat', path FROM f WHERE regexp_matches(lower(path), '[.](jpg|jpeg|png)$') AND NOT path LIKE 'sub/%'"""
)
def image_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of one byte for each nation, a table of fixed size."""
    folder = scratch(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in (r.n_nationkey for r in R.table(spark, sf_dir, "nation").select("n_nationkey").collect()):
        file = store.create(hadoop.Path(f"{folder}/{'sub/' if k % 3 == 0 else ''}{k}.{_ENDINGS[k % 7]}"))
        file.write(1)
        file.close()
    found = {
        "common": images.scan(spark, folder),
        "six": images.scan(spark, folder, images.ALL),
        "cased": images.scan(spark, folder, (".jpg",), case_sensitive=True),
        "flat": images.scan(spark, folder, recursive=False),
    }
    out = None
    for way, df in found.items():
        part = images.relative(df, re.sub("^file:/+", "/", folder)).select(F.lit(way).alias("way"), "path")
        out = part if out is None else out.unionByName(part)
    return out


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn")


def _arrays(df: DataFrame) -> str:
    path = scratch(df.sparkSession)
    sinks.json_arrays(df, path)
    return path


_SQL_WORDS = r"""trim(rtrim(regexp_replace(regexp_replace(lower(text), '[.!"()*#:;~]', ' ', 'g'), '\s{2,}', ' ', 'g'), chr(10)), ' ')"""
_SQL_CAPTION = f"array_to_string(list_slice(string_split({_SQL_WORDS}, ' '), 1, 30), ' ')"


@query(f"SELECT '/i/' || conv_id || '.jpg' AS image, 'a picture of ' || {_SQL_CAPTION} AS caption, dense_rank() OVER (ORDER BY conv_id) - 1 AS img_id FROM conversations")
def annotations_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by first appearance over several files."""
    rows = _turns(spark, sf_dir).select(F.concat("conv_id", F.lit(".jpg")).alias("image"), F.col("text").alias("caption"), F.concat(F.lit("k"), "conv_id").alias("image_id"))
    return annotations.caption_train(spark, _arrays(rows), "/i", "a picture of ")


@query(
    f"""WITH c AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) - 1 AS img_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS txt_id FROM conversations)
SELECT img_id, txt_id, '/i/' || conv_id || '.jpg' AS image, {_SQL_CAPTION} AS caption FROM c"""
)
def annotations_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = R.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    rows = lists.orderBy("conv_id").select(F.concat("conv_id", F.lit(".jpg")).alias("image"), F.col("l.text").alias("caption"))
    pictures, texts = annotations.retrieval_eval(spark, _arrays(rows), "/i")
    return texts.join(pictures, "img_id").select("img_id", "txt_id", "image", "caption")


@query("SELECT '/c/val_' || lpad(doc_id::VARCHAR, 12, '0') || '.jpg' AS image, doc_id::INT AS img_id, 'coco' AS kind FROM documents UNION ALL SELECT '/n/' || doc_id || '.jpg', doc_id::INT, 'nocaps' FROM documents")
def annotations_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents")
    coco = annotations.caption_eval(spark, _arrays(d.select(F.concat(F.lit("val_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".jpg")).alias("image"), F.array("source").alias("caption"))), "/c")
    nocaps = annotations.nocaps(spark, _arrays(d.select(F.concat("doc_id", F.lit(".jpg")).alias("image"), F.col("doc_id").cast("int").alias("img_id"))), "/n")
    return coco.withColumn("img_id", F.col("img_id").cast("int")).withColumn("kind", F.lit("coco")).unionByName(nocaps.withColumn("kind", F.lit("nocaps")))


@query(
    r"""WITH c AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'vqa' ELSE 'vg' END AS dataset, rtrim(regexp_replace(lower(text), '[.!"()*#:;~]', '', 'g'), ' ') AS q FROM benchmark)
SELECT dataset, CASE dataset WHEN 'vqa' THEN '/a/' ELSE '/b/' END || item_id || '.jpg' AS image, item_id AS question_id, array_to_string(list_slice(string_split(q, ' '), 1, 50), ' ') AS question,
  CASE dataset WHEN 'vqa' THEN '["yes","no"]' ELSE 'me' END AS answer FROM c"""
)
def annotations_vqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files: answers are lists in one set, and single in the other."""
    b = R.table(spark, sf_dir, "benchmark")
    files = []
    for name, k, answer in (("vqa", 0, F.array(F.lit("yes"), F.lit("no"))), ("vg", 1, F.lit("me"))):
        rows = b.where(F.col("item_id") % 2 == k).select(F.lit(name).alias("dataset"), F.concat("item_id", F.lit(".jpg")).alias("image"), F.col("text").alias("question"), F.col("item_id").alias("question_id"), answer.alias("answer"))
        files.append(_arrays(rows))
    return annotations.vqa(spark, *files, roots={"vqa": "/a", "vg": "/b"})


@query(f"SELECT conv_id || '.jpg' AS image, {_SQL_CAPTION} AS caption FROM conversations WHERE conv_id % 4 IN (0, 2)")
def annotations_pretrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of the base and three shards, of which epoch 4 takes the second."""
    c = R.table(spark, sf_dir, "conversations")
    parts = [_arrays(c.where(F.col("conv_id") % 4 == k).select(F.concat("conv_id", F.lit(".jpg")).alias("image"), F.col("text").alias("caption"))) for k in range(4)]
    return annotations.pretrain(spark, parts[:1], parts[1:], epoch=4)


@query("SELECT '/v/c' || conv_id || '_' || turn || '.mp4' AS video, text AS caption, row_number() OVER (ORDER BY conv_id, turn) - 1 AS txt_id FROM conversations")
def annotations_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _turns(spark, sf_dir).select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("clip_name"), F.col("text").alias("caption")).write.json(path)
    return annotations.video(spark, path, "/v")


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, loaded, and loaded again where a cache is asked for: the second call must not build."""
    path = scratch(spark)

    def never() -> DataFrame:
        raise AssertionError("the cache is there")

    sinks.descriptors(R.table(spark, sf_dir, "embeddings"), f"{path}/store")
    tables.cached(spark, f"{path}/cache", lambda: tables.descriptors(spark, f"{path}/store"))
    again = tables.cached(spark, f"{path}/cache", never)
    return again.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events)
SELECT user_id::VARCHAR AS query, '{"query":"' || user_id || '","top_k":' || count(*) || ',"results":[' || string_agg('{"rank":' || rank || ',"path":"p' || event_id || '","similarity":' || (rank / 4.0)::DOUBLE || '}', ',' ORDER BY rank) || ']}' AS value
FROM r WHERE rank <= 5 GROUP BY user_id"""
)
def search_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    r = R.table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).where("rank <= 5")
    return sinks.search_json(r.select(F.col("user_id").cast("string").alias("query"), "rank", F.concat(F.lit("p"), "event_id").alias("path"), (F.col("rank") / 4.0).alias("similarity")))


@query("SELECT 'quality' AS meter, quality::BIGINT AS step, count(*) AS n FROM labels GROUP BY quality UNION ALL SELECT 'toxic', toxic::BIGINT, count(*) FROM labels GROUP BY toxic")
def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one log."""
    path, labels = scratch(spark), R.table(spark, sf_dir, "labels")
    for name in ("quality", "toxic"):
        sinks.append_metrics(labels.groupBy(F.col(name).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n")).withColumn("meter", F.lit(name)), path)
    return spark.read.schema("meter string, step long, n long").json(path)


@query("SELECT 'path' AS \"column\", '/data/img/' || o_orderkey AS before, '/mnt/img/' || o_orderkey AS after FROM orders ORDER BY before LIMIT 5")
def path_change_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of changes that a path replacement shows: the limit is the feature."""
    o = R.table(spark, sf_dir, "orders").select(F.concat(F.lit("/data/img/"), "o_orderkey").alias("path"))
    return reshape.change_sample(o, "/data/", "/mnt/", ["path"])


_SQL_ONE_SPACE = r"regexp_replace(trim(text, ' '), '\s+', ' ', 'g')"


@query(
    rf"SELECT conv_id, turn, CASE WHEN length(text) <= 50 THEN text ELSE rtrim(regexp_replace({_SQL_ONE_SPACE}, '(.{{1,50}})( |$)', '\1' || chr(10), 'g'), chr(10)) END AS wrapped FROM conversations"
)
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.wrapped(F.col("text")).alias("wrapped"))


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT event_id, user_id, value FROM events")
def stream_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    streams.persisted(_event_stream(spark, sf_dir).select("event_id", "user_id", "value"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long, user_id long, value double").parquet(f"{path}/rows").select("event_id", "user_id", "value")


@query(
    """WITH r AS (SELECT event_type AS meter, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT meter, n, round(sum(value), 4) AS total, round(max(CASE WHEN back = 1 THEN value END), 6) AS latest FROM r WHERE back <= 576 GROUP BY meter, n"""
)
def stream_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _event_stream(spark, sf_dir).select(F.col("event_id").alias("ts"), F.col("event_type").alias("meter"), "value")
    name = f"ring_{uuid.uuid4().hex}"
    state = streams.ring_buffer(s, 576).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", scratch(spark))
    state.trigger(availableNow=True).start().awaitTermination()
    last = spark.table(name).groupBy("meter").agg(F.max_by(F.struct("n", "total", "latest"), "n").alias("s"))
    return last.select("meter", "s.n", F.round("s.total", 4).alias("total"), F.round("s.latest", 6).alias("latest"))
