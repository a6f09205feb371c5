"""Small functions and checks on every row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, paths, text, vectors
from ..operators import captions, dedup, lookup, metrics, reshape
from ..sources import images
from . import query
from . import relations as R


def _s(c) -> F.Column:
    return c.cast("string")


_WSL = "CASE k % 3 WHEN 0 THEN '/mnt/c/a/' || k || '.jpg' WHEN 1 THEN '/mnt/d/x/' || k ELSE '/home/' || k END"


@query(rf"WITH t AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, {_WSL} AS p FROM t) SELECT k, CASE WHEN starts_with(p, '/mnt/') THEN replace(replace(p, '/mnt/c/', 'C:\'), '/', '\') ELSE p END AS path FROM p")
def wsl_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.when(k % 3 == 0, F.concat(F.lit("/mnt/c/a/"), _s(k), F.lit(".jpg"))).when(k % 3 == 1, F.concat(F.lit("/mnt/d/x/"), _s(k))).otherwise(F.concat(F.lit("/home/"), _s(k)))
    return R.table(spark, sf_dir, "orders").select(k.alias("k"), paths.wsl_to_windows(p).alias("path"))


@query("SELECT p_partkey, p_partkey::INT AS img_id FROM part")
def coco_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("val2014/COCO_val2014_"), F.lpad(_s(F.col("p_partkey")), 12, "0"), F.lit(".jpg"))
    return R.table(spark, sf_dir, "part").select("p_partkey", paths.coco_id(name).alias("img_id"))


@query("SELECT conv_id, turn, trim('\"''' || text || '''', '\"''') AS plain FROM conversations")
def quotes_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("\"'"), F.col("text"), F.lit("'"))
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.unquoted(quoted).alias("plain"))


@query("WITH t AS (SELECT o_orderkey AS k, 'a' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE 'jpeg' END AS name FROM orders) SELECT k, name FROM t WHERE k % 4 < 2")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("a"), _s(k), F.when(k % 4 == 0, ".JPG").when(k % 4 == 1, ".png").when(k % 4 == 2, ".txt").otherwise("jpeg"))
    return R.table(spark, sf_dir, "orders").select(k.alias("k"), name.alias("name")).where(paths.has_extension(F.col("name"), images.COMMON))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 1 OR c_custkey % 5 = 0")
def with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    wide = R.table(spark, sf_dir, "customer").select(k, F.when(k % 3 == 0, "").when(k % 3 == 1, "a.jpg").alias("reference_1_path"), F.when(k % 5 == 0, "b.jpg").otherwise("  ").alias("reference_2_path"))
    return reshape.has_reference(wide).select("c_custkey")


@query("SELECT c_custkey, unnest(range(0, c_custkey % 4))::INT AS copy FROM customer")
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).cast("int").alias("times"))
    return lookup.repeated(rows.where("times > 0"), "times").select("c_custkey", "copy")


@query("SELECT event_id, round(value / nullif(event_id % 7, 0), 9) AS sec_per_image, round((event_id % 7) / nullif(value, 0), 9) AS images_per_sec FROM events")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events").select("event_id", metrics.throughput((F.col("event_id") % 7).cast("double"), F.col("value")).alias("t"))
    return e.select("event_id", F.round("t.sec_per_image", 9).alias("sec_per_image"), F.round("t.images_per_sec", 9).alias("images_per_sec"))


@query(
    """SELECT p_partkey, CASE WHEN g >= 16 THEN 64 WHEN g >= 8 THEN 32 WHEN g >= 4 THEN 16 WHEN g >= 2 THEN 8 ELSE 4 END AS clip,
  CASE WHEN g >= 24 THEN 16 WHEN g >= 16 THEN 8 WHEN g >= 8 THEN 4 WHEN g >= 4 THEN 2 ELSE 1 END AS blip FROM (SELECT p_partkey, p_partkey % 30 AS g FROM part)"""
)
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("p_partkey") % 30
    return R.table(spark, sf_dir, "part").select("p_partkey", numbers.batch_rows(g, "clip").alias("clip"), numbers.batch_rows(g, "blip").alias("blip"))


@query(
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT pos, o_orderkey, c_custkey FROM a JOIN b USING (pos)"""
)
def joined_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = images.numbered(R.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "pos")
    b = images.numbered(R.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "pos")
    return lookup.by_position(a, b).select("pos", "o_orderkey", "c_custkey")


@query("SELECT page_id, path, arg_min(text, doc_id) AS description FROM (SELECT page_id, 'src' || (page_id % 3) AS path FROM pages) JOIN documents ON path = 'src' || (doc_id % 3) GROUP BY page_id, path")
def desc_lookup_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path has a description, so none is missing."""
    d = R.table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), F.col("doc_id") % 3).alias("image_path"), F.col("text").alias("description"), "doc_id")
    i = R.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src"), F.col("page_id") % 3).alias("path"))
    return lookup.describe(i, d, ["doc_id"], missing=None)


_NUDGED = """c AS (SELECT vec_id AS k, embedding AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x: (x::DOUBLE + 1e-7)::FLOAT) FROM embeddings WHERE vec_id % 3 = 0),
m AS (SELECT k, list_transform(v, lambda x: x::DOUBLE) AS v FROM c), n AS (SELECT k, v, list_sum(v) / len(v) AS mean FROM m),
f AS (SELECT k, v, round_even(mean, 4) AS mean, round_even(sqrt(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / (len(v) - 1)), 4) AS std, round_even(list_min(v), 4) AS low, round_even(list_max(v), 4) AS high FROM n)"""


def _nudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptors, every third a second time, each number moved by 1e-7."""
    e = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    moved = F.transform("embedding", lambda x: (x.cast("double") + F.lit(1e-7)).cast("float"))
    return e.unionByName(e.where("image_id % 3 = 0").select((F.col("image_id") + 1000000).alias("image_id"), moved.alias("embedding")))


@query(f"WITH {_NUDGED} SELECT k AS image_id, mean, std, low, high FROM f")
def descriptor_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _nudged(spark, sf_dir).select("image_id", vectors.fingerprint(F.col("embedding")).alias("f"))
    return f.select("image_id", "f.mean", "f.std", F.col("f.min").alias("low"), F.col("f.max").alias("high"))


@query(
    f"""WITH {_NUDGED}, b AS (SELECT DISTINCT y.k FROM f x JOIN f y ON x.mean = y.mean AND x.std = y.std AND x.low = y.low AND x.high = y.high AND x.k < y.k
  WHERE len(list_filter(list_zip(y.v, x.v), lambda z: abs(z[1] - z[2]) > 1e-5 + 1e-5 * abs(z[2]))) = 0)
SELECT k AS image_id FROM f WHERE k NOT IN (SELECT k FROM b)"""
)
def dedup_nudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near(_nudged(spark, sf_dir)).select("image_id")


@query()
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    length = 8 + k % 90
    return R.table(spark, sf_dir, "part").select("p_partkey", length.alias("length"), numbers.random_frames(k, length, 8, 7).alias("random"), numbers.head_and_tail_frames(k, length, 8, 7).alias("headtail"))


@query(
    """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn > 0)),
g AS (SELECT conv_id, turn, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest(range(1, 5)) AS n FROM w)) GROUP BY ALL),
m AS (SELECT conv_id, n, gram, max(c) AS m FROM g WHERE turn > 0 GROUP BY ALL),
p AS (SELECT n, sum(least(c, coalesce(m, 0))) / sum(c) AS p FROM (SELECT * FROM g WHERE turn = 0) LEFT JOIN m USING (conv_id, n, gram) GROUP BY n),
l AS (SELECT a.conv_id, len(a.w) AS own, arg_min(len(b.w), (abs(len(a.w) - len(b.w)), len(b.w))) AS wanted FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0 GROUP BY ALL),
s AS (SELECT least(1.0, exp(1 - sum(wanted) / sum(own))) AS bp FROM l)
SELECT k.n::INT AS n, round(bp * CASE WHEN min(p.p) > 0 THEN exp(avg(ln(nullif(p.p, 0)))) ELSE 0 END, 9) AS bleu FROM range(1, 5) k(n) JOIN p ON p.n <= k.n, s GROUP BY k.n, bp"""
)
def caption_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's first turn as the candidate, its other turns as references."""
    t = R.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ref"), "text")
    return captions.bleu(t.where("ref = 0").drop("ref"), t.where("ref > 0")).select("n", F.round("bleu", 9).alias("bleu"))


@query("SELECT page_id, '/img/a b ' || page_id || '.jpg' AS path, CASE page_id % 3 WHEN 0 THEN '/img/a b ' || page_id || '.jpg' WHEN 1 THEN '/img/a%20b%20' || page_id || '.jpg' END AS existing FROM pages")
def alternative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with spaces; a third of the files is there as named, a third with the spaces escaped."""
    k = F.col("page_id")
    p = R.table(spark, sf_dir, "pages").select(k, F.concat(F.lit("/img/a b "), _s(k), F.lit(".jpg")).alias("path"))
    found = p.where("page_id % 3 < 2").select(F.when(k % 3 == 1, F.replace("path", F.lit(" "), F.lit("%20"))).otherwise(F.col("path")).alias("path"))
    return images.first_existing(p, found).select("page_id", "path", "existing")


@query("SELECT item_id, unnest(['One of item ' || item_id || '.', 'Is it 3.5, e.g. so?', '\"Yes!\"', 'Last']) AS sentence FROM benchmark")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit(" One of item "), _s(F.col("item_id")), F.lit(".\nIs it 3.5, e.g. so?  \"Yes!\" Last "))
    return R.table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.sentences(t)).alias("sentence"))
