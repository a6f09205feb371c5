"""Coordinates, paths, radius and nearest joins, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PlaceConfig
from ..functions import numbers, paths
from ..operators import geo, metrics, places, reshape
from ..plans import analysis
from ..sources import images
from . import query
from . import relations as R

_ORDERS = R.sql_points("o", "orders", "o_orderkey", "true", "image_id")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.points(spark, sf_dir, "orders", "o_orderkey", "true", "image_id")


#: Names of several kinds, from a key.
_NAMES_SQL = """CASE k % 4 WHEN 0 THEN '@' || (k % 1000) || '.5@' || (k % 777) || '@x' || k || '@.jpg'
  WHEN 1 THEN 'img_' || (543000 + k % 1000) || '.25_' || (4178000 + k % 1000) || '.50.png'
  WHEN 2 THEN 'place ' || (30 + k % 15) || '.5,-' || (100 + k % 20) || '.25 a.jpg' ELSE 'no_numbers.jpg' END"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("@"), s(k % 1000), F.lit(".5@"), s(k % 777), F.lit("@x"), s(k), F.lit("@.jpg")))
        .when(k % 4 == 1, F.concat(F.lit("img_"), s(F.lit(543000) + k % 1000), F.lit(".25_"), s(F.lit(4178000) + k % 1000), F.lit(".50.png")))
        .when(k % 4 == 2, F.concat(F.lit("place "), s(F.lit(30) + k % 15), F.lit(".5,-"), s(F.lit(100) + k % 20), F.lit(".25 a.jpg")))
        .otherwise(F.lit("no_numbers.jpg"))
    )
    return R.table(spark, sf_dir, "orders").select(k.alias("k"), name.alias("name"))


_STRICT = r"'@(\d+\.?\d*)@(\d+\.?\d*)@.*\.jpg'"


@query(f"WITH t AS (SELECT o_orderkey AS k FROM orders), n AS (SELECT k, {_NAMES_SQL} AS name FROM t) SELECT k, nullif(regexp_extract(name, {_STRICT}, 1), '')::DOUBLE AS utm_east, nullif(regexp_extract(name, {_STRICT}, 2), '')::DOUBLE AS utm_north FROM n")
def utm_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("k", paths.utm_strict(F.col("name")).alias("u")).select("k", "u.utm_east", "u.utm_north")


@query(
    f"""WITH t AS (SELECT o_orderkey AS k FROM orders), n AS (SELECT k, {_NAMES_SQL} AS name FROM t)
SELECT k, CASE k % 4 WHEN 0 THEN (k % 1000) + 0.5::DOUBLE WHEN 1 THEN 543000 + k % 1000 + 0.25::DOUBLE
    WHEN 2 THEN round((-(100 + k % 20 + 0.25::DOUBLE) + 123.0) * 111320.0 * cos(radians(30 + k % 15 + 0.5::DOUBLE)), 4) END AS utm_east,
  CASE k % 4 WHEN 0 THEN (k % 777)::DOUBLE WHEN 1 THEN 4178000 + k % 1000 + 0.5::DOUBLE WHEN 2 THEN round((30 + k % 15 + 0.5::DOUBLE - 49.0) * 111320.0, 4) END AS utm_north FROM n"""
)
def utm_parse_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _names(spark, sf_dir).select("k", paths.utm_cascade(F.concat(F.lit("/a@1@2@/"), F.col("name"))).alias("u"))
    return u.select("k", F.round("u.utm_east", 4).alias("utm_east"), F.round("u.utm_north", 4).alias("utm_north"))


@query(f"WITH {_ORDERS} SELECT image_id, e AS utm_east, n AS utm_north, heading FROM o")
def utm_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("image_id", paths.utm_fields(F.col("path")).alias("u")).select("image_id", "u.*")


@query(f"WITH t AS (SELECT o_orderkey AS k FROM orders), n AS (SELECT k, {_NAMES_SQL} AS name FROM t) SELECT k, (k % 1000) + 0.5::DOUBLE AS utm_east, (k % 777)::DOUBLE AS utm_north FROM n WHERE k % 4 = 0")
def images_with_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir).withColumnRenamed("name", "path")
    return images.with_coordinates(rows).select("k", "utm_east", "utm_north")


@query(
    f"""WITH {_ORDERS} SELECT image_id, '@0' || split_part(path, '/@0', 2) AS basename, 'images/' || regexp_extract(path, '([^/]*)$', 1) AS relative,
  'D:/new/' || regexp_extract(path, '([^/]*)$', 1) AS rebased, left(regexp_extract(path, '([^/]*)$', 1), 17) || '...' AS compact,
  left(regexp_extract(path, '([^/]*)$', 1), 8) || '....jpg' AS shortened, 'gs://b/p/images/' || regexp_extract(path, '([^/]*)$', 1) AS uri,
  printf('%03d.jpg', image_id) AS report FROM o"""
)
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _orders(spark, sf_dir).select(
        "image_id", paths.basename(p).alias("basename"), paths.relative(p, "/data").alias("relative"), paths.rebased(p, "D:/new/").alias("rebased"),
        paths.compact(p).alias("compact"), paths.shortened(p).alias("shortened"), paths.object_uri("b", "p/", p).alias("uri"), paths.report_name(F.col("image_id")).alias("report"),
    )


@query(f"WITH {_ORDERS} SELECT image_id, replace(path, '/data/images', '/mnt/set') AS path FROM o")
def path_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.replaced_paths(_orders(spark, sf_dir).select("image_id", "path"), "/data/images", "/mnt/set")[0]


@query("SELECT 'path' AS \"column\", count(*) FILTER (WHERE url <> replace(url, 'https://', 'http://')) AS changed FROM pages")
def path_replace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return reshape.replaced_paths(rows, "https://", "http://")[1]


@query(
    f"""WITH {R.SQL_QUERY_POINTS}, {R.SQL_DATABASE_POINTS}, s AS (SELECT query_id, db_id, sqrt((q.e - d.e) * (q.e - d.e) + (q.n - d.n) * (q.n - d.n)) AS s FROM q, d)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s, db_id)::INT AS rank, db_id, round(s, 6) AS distance FROM s QUALIFY rank <= 5"""
)
def geo_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nearest(R.query_points(spark, sf_dir), R.database_points(spark, sf_dir), 5).withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH {R.SQL_QUERY_POINTS}, {R.SQL_DATABASE_POINTS}, s AS (SELECT query_id, db_id, sqrt((q.e - d.e) * (q.e - d.e) + (q.n - d.n) * (q.n - d.n)) AS s FROM q, d)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s, db_id)::INT AS rank, db_id, round(s, 6) AS distance FROM s QUALIFY rank <= 5"""
)
def geo_topk_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nearest_by_rings(R.query_points(spark, sf_dir), R.database_points(spark, sf_dir), 5).withColumn("distance", F.round("distance", 6))


_WIDE = f"""WITH {R.SQL_QUERY_POINTS}, {R.SQL_DATABASE_POINTS}, s AS (
  SELECT query_id, q.path AS qp, q.e AS qe, q.n AS qn, db_id, d.path AS path, d.e AS e, d.n AS n, sqrt((q.e - d.e) * (q.e - d.e) + (q.n - d.n) * (q.n - d.n)) AS s FROM q, d
), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, db_id) AS r FROM s QUALIFY r <= 3)"""
_REFS = ", ".join(f"max(CASE WHEN r = {i} THEN {v} END) AS reference_{i}_{f}" for i in (1, 2, 3) for f, v in (("path", "path"), ("distance", "round(s, 6)"), ("utm_east", "e"), ("utm_north", "n")))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.query_points(spark, sf_dir).withColumnRenamed("path", "query_image_path")
    return analysis.nearest_references(q, R.database_points(spark, sf_dir), 3)


GEO_TOPK_WIDE = _WIDE + f" SELECT query_id, qp AS query_image_path, qe AS utm_east, qn AS utm_north, {_REFS} FROM p GROUP BY 1, 2, 3, 4"


@query(GEO_TOPK_WIDE)
def geo_topk_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).withColumns({f"reference_{i}_distance": F.round(f"reference_{i}_distance", 6) for i in (1, 2, 3)})


@query(_WIDE + " SELECT query_id, r::INT AS rank, round(s, 6) AS physical FROM p")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.physical_distances(_wide(spark, sf_dir)).withColumn("physical", F.round("physical", 6))


@query(
    _WIDE
    + """, g AS (SELECT r::INT AS rank, count(*) AS n, avg(s) AS mean, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.75) AS q3 FROM p GROUP BY 1)
SELECT rank, any_value(g.n) AS n, round(any_value(mean), 6) AS mean, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(s), 6) AS low, round(max(s), 6) AS high FROM g JOIN p ON p.r = g.rank WHERE s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY rank"""
)
def rank_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.distance_figures(_wide(spark, sf_dir))[0]
    return out.select("rank", "n", *[F.round(c, 6).alias(c) for c in ("mean", "q1", "median", "q3", "low", "high")])


@query(
    """WITH v AS (SELECT event_type, value AS v FROM events WHERE value IS NOT NULL), g AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1)
SELECT event_type, least(floor((v - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS count FROM v JOIN g USING (event_type) GROUP BY 1, 2"""
)
def distance_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(R.table(spark, sf_dir, "events"), "value", "event_type", 30)


@query(f"WITH {_ORDERS} SELECT count(*) AS total, min(e) AS min_east, max(e) AS max_east, min(n) AS min_north, max(n) AS max_north FROM o")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.statistics(_orders(spark, sf_dir))


@query(f"WITH {R.SQL_QUERY_POINTS}, {R.SQL_DATABASE_POINTS} SELECT query_id, db_id, round(sqrt((q.e - d.e) * (q.e - d.e) + (q.n - d.n) * (q.n - d.n)), 6) AS distance FROM q, d WHERE (q.e - d.e) * (q.e - d.e) + (q.n - d.n) * (q.n - d.n) <= 625")
def radius_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.within_radius(R.query_points(spark, sf_dir), R.database_points(spark, sf_dir), 25.0).withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH {R.SQL_QUERY_POINTS}, {R.SQL_DATABASE_POINTS}, s AS (SELECT query_id, db_id, sqrt((q.e - d.e) * (q.e - d.e) + (q.n - d.n) * (q.n - d.n)) AS s FROM q, d),
f AS (SELECT query_id, min(s) AS s FROM s GROUP BY 1)
SELECT k, round(100.0 * avg(CASE WHEN s <= 25 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM f, (VALUES (1), (5)) t(k) GROUP BY k"""
)
def geo_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = R.query_points(spark, sf_dir), R.database_points(spark, sf_dir)
    truth = geo.within_radius(q, d, 25.0).select("query_id", "db_id")
    return metrics.recall_at(q.select("query_id"), geo.nearest(q, d, 5), truth, (1, 5)).select("k", F.round("recall", 6).alias("recall"))


_PLACE = PlaceConfig(m=100, alpha=60, n=5, l=2, min_images_per_class=2)
_CLASSES = f"""WITH {_ORDERS}, c AS (
  SELECT image_id, (floor(e / 100) * 100)::BIGINT AS ce, (floor(n / 100) * 100)::BIGINT AS cn, (floor(heading / 60) * 60)::BIGINT AS ch FROM o
), g AS (
  SELECT ce, cn, ch, ce % 500 // 100 AS ge, cn % 500 // 100 AS gn, ch % 120 // 60 AS gh, count(*) AS n_images, min(image_id) AS first_image, list(image_id ORDER BY image_id) AS images
  FROM c GROUP BY ALL HAVING count(*) >= 2
)"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.kept_classes(places.classified(_orders(spark, sf_dir), _PLACE), _PLACE)


@query(_CLASSES + " SELECT ce, cn, ch, n_images, array_to_string(images, ',') AS images FROM g")
def place_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).select("class_id.*", "n_images", F.array_join(F.col("images").cast("array<string>"), ",").alias("images"))


@query(
    _CLASSES
    + """ SELECT ge, gn, gh, row_number() OVER (ORDER BY min(first_image)) - 1 AS group_index, count(*) AS n_classes, sum(n_images)::BIGINT AS n_images,
  string_agg(ce || '/' || cn || '/' || ch, ',' ORDER BY ce, cn, ch) AS classes FROM g GROUP BY ge, gn, gh"""
)
def place_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.transform("classes", lambda c: F.concat_ws("/", c["ce"].cast("string"), c["cn"].cast("string"), c["ch"].cast("string"))), ",")
    return places.groups(_classes(spark, sf_dir)).select("group_id.*", "group_index", "n_classes", "n_images", joined.alias("classes"))


@query(_CLASSES + " SELECT image_id FROM c SEMI JOIN g USING (ce, cn, ch)")
def place_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.kept_images(places.classified(_orders(spark, sf_dir), _PLACE), _PLACE).select("image_id")


@query(
    f"""WITH {_ORDERS}, {R.SQL_DATABASE_POINTS}, a AS (SELECT row_number() OVER (ORDER BY path) - 1 AS image_id, path FROM d), b AS (SELECT row_number() OVER (ORDER BY path) - 1 AS image_id, path FROM o)
SELECT image_id, path, 'database' AS role FROM a UNION ALL SELECT image_id + (SELECT count(*) FROM a), path, 'query' FROM b"""
)
def union_db_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = images.numbered(R.database_points(spark, sf_dir).select("path")), images.numbered(_orders(spark, sf_dir).select("path"))
    return images.database_and_queries(d, q)


@query(f"WITH {_ORDERS} SELECT path FROM o ORDER BY path LIMIT 50 OFFSET 100")
def offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.section(_orders(spark, sf_dir).select("path"), 100, 50)


@query(
    """WITH s AS (SELECT p_partkey AS image_id, 200 + p_partkey * 37 % 1400 AS w, 200 + p_partkey * 91 % 1400 AS h FROM part),
g AS (SELECT i.i AS gw, j.j AS gh FROM range(1, 13) i(i), range(1, 13) j(j) WHERE i.i * j.j <= 12),
r AS (SELECT image_id, w, h, gw, gh, abs(w / h - gw / gh) AS d FROM s, g), m AS (SELECT *, min(d) OVER (PARTITION BY image_id) AS best FROM r),
t AS (SELECT *, gw * gh AS area, row_number() OVER (PARTITION BY image_id ORDER BY gw * gh, gw) AS first FROM m WHERE d = best)
SELECT image_id, arg_max(gw, CASE WHEN first = 1 THEN 0 WHEN w * h > 100352.0 * area THEN first ELSE -1 END)::INT AS gw,
  arg_max(gh, CASE WHEN first = 1 THEN 0 WHEN w * h > 100352.0 * area THEN first ELSE -1 END)::INT AS gh FROM t GROUP BY image_id"""
)
def tile_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sized = R.table(spark, sf_dir, "part").select(k.alias("image_id"), (F.lit(200) + k * 37 % 1400).alias("width"), (F.lit(200) + k * 91 % 1400).alias("height"))
    return sized.select("image_id", numbers.tile_ratio(F.col("width"), F.col("height")).alias("g")).select("image_id", F.col("g.w").alias("gw"), F.col("g.h").alias("gh"))
