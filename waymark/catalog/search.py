"""Descriptor search, recall, reports, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions import text, vectors
from ..operators import dedup, knn, losses, metrics
from ..plans import recall, retrieval
from . import query
from . import relations as R

_L2 = R.SQL_L2.format(a="q.embedding", b="d.embedding")
_L1 = R.SQL_L1.format(a="q.embedding", b="d.embedding")
_DOT = R.SQL_DOT.format(a="q.embedding", b="d.embedding")
_COS = f"({_DOT}) / ((({R.SQL_NORM.format(a='q.embedding')}) + 1e-8) * (({R.SQL_NORM.format(a='d.embedding')}) + 1e-8))"


def _ranked(score: str, order: str, k: int, where: str = "true", name: str = "p") -> str:
    return f"""
WITH {R.SQL_VECTORS}, s AS (
  SELECT query_id, db_id, q.label AS ql, d.label AS dl, {score} AS s FROM q, d
), {name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {order}, db_id)::INT AS rank FROM s WHERE {where}
  QUALIFY rank <= {k}
)"""


_TOP20 = _ranked(_L2, "ASC", 20)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir)
    return q.select("query_id", "label").join(d.select("db_id", "label"), "label").select("query_id", "db_id")


@query(
    _TOP20
    + """, h AS (SELECT query_id, min(rank) AS first FROM p WHERE ql = dl GROUP BY 1)
SELECT k, round(100.0 * avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM q LEFT JOIN h USING (query_id), (VALUES (1), (5), (10), (20)) t(k) GROUP BY k"""
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir)
    return recall.evaluate(q, d, _truth(spark, sf_dir))[0].select("k", F.round("recall", 6).alias("recall"))


@query(_TOP20 + " SELECT query_id, rank, db_id, round(s, 6) AS distance FROM p")
def knn_l2_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.nearest(R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir), 20)
    return found.withColumn("distance", F.round("distance", 6))


@query(_TOP20 + " SELECT query_id, rank, db_id, round(s, 6) AS distance FROM p")
def knn_l2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.nearest(R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir), 20, way="blocks")
    return found.withColumn("distance", F.round("distance", 6))


def _search(spark: SparkSession, sf_dir: str, metric: str, threshold: float = 0.0, normalise: bool = True) -> DataFrame:
    found = knn.search(R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir), metric, 10, threshold, normalise)
    return found.select("query_id", "rank", "db_id", F.round("similarity", 6).alias("similarity"), F.round(vectors.distance_of(F.col("similarity")), 6).alias("distance"))


_OUT = " SELECT query_id, rank, db_id, round(s, 6) AS similarity, round(1 - s, 6) AS distance FROM p"


@query(_ranked(_COS, "DESC", 10) + _OUT)
def search_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "cosine")


@query(_ranked(_COS, "DESC", 10) + _OUT)
def search_dot_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "dot_product")


@query(_ranked(_DOT, "DESC", 10) + _OUT)
def search_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "dot_product", normalise=False)


@query(_ranked(f"-({_L2})", "DESC", 10) + _OUT)
def search_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "euclidean")


@query(_ranked(f"-({_L1})", "DESC", 10) + _OUT)
def search_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "manhattan")


@query(_ranked(_COS, "DESC", 10, "s >= 0.25") + _OUT)
def search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "cosine", threshold=0.25)


_RETRIEVED = f"""
WITH {R.SQL_VECTORS}, t AS (
  SELECT query_id, q.embedding, text AS description, length(text) > 300 AS failed FROM q JOIN documents ON doc_id = query_id
), u AS (SELECT min(db_id) AS db_id FROM d GROUP BY embedding), s AS (
  SELECT q.query_id, d.db_id, {_COS} AS s FROM t q, d WHERE NOT failed AND d.db_id IN (SELECT db_id FROM u)
), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, db_id) AS r FROM s QUALIFY r <= 3)
SELECT query_id, description AS query_description, failed, (SELECT count(*) FROM p WHERE p.query_id = t.query_id) AS n_matches,
  max(CASE WHEN r = 1 THEN {R.SQL_PATH.format(k="db_id")} END) AS reference_1_path, max(CASE WHEN r = 1 THEN round(1 - s, 6) END) AS reference_1_distance,
  max(CASE WHEN r = 1 THEN {R.SQL_EAST.format(k="db_id")} END) AS reference_1_utm_east, max(CASE WHEN r = 1 THEN {R.SQL_NORTH.format(k="db_id")} END) AS reference_1_utm_north,
  max(CASE WHEN r = 2 THEN {R.SQL_PATH.format(k="db_id")} END) AS reference_2_path, max(CASE WHEN r = 2 THEN round(1 - s, 6) END) AS reference_2_distance,
  max(CASE WHEN r = 3 THEN {R.SQL_PATH.format(k="db_id")} END) AS reference_3_path, max(CASE WHEN r = 3 THEN round(1 - s, 6) END) AS reference_3_distance
FROM t LEFT JOIN p USING (query_id) GROUP BY 1, 2, 3"""


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.query_vectors(spark, sf_dir).join(R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("description")), "query_id")
    q = q.withColumn("image_path", R.path(F.col("query_id")))
    d = R.database_vectors(spark, sf_dir).withColumn("path", R.path(F.col("db_id")))
    return retrieval.retrieve(q, d, RetrievalConfig(), 3)


@query(_RETRIEVED)
def retrieval_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _retrieved(spark, sf_dir)
    r = [F.round(f"reference_{i}_distance", 6).alias(f"reference_{i}_distance") for i in (1, 2, 3)]
    return out.select("query_id", "query_description", "failed", "n_matches", *[f"reference_{i}_path" for i in (1, 2, 3)], *r, "reference_1_utm_east", "reference_1_utm_north")


@query(f"SELECT query_description AS query, 3 AS top_k, n_matches AS results_count, 'cosine' AS similarity_metric, 0.0::DOUBLE AS min_threshold FROM ({_RETRIEVED})")
def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.history(_retrieved(spark, sf_dir), RetrievalConfig(), 3).drop("timestamp")


@query(
    f"""
WITH {R.SQL_VECTORS}, t AS (SELECT query_id, text AS description, length(text) > 300 AS failed FROM q JOIN documents ON doc_id = query_id)
SELECT count(*) AS total_queries, sum(CASE WHEN failed THEN 0 ELSE 1 END)::BIGINT AS successful_queries, sum(failed::INT)::BIGINT AS failed_queries,
  sum(CASE WHEN failed THEN 0 ELSE 3 END)::BIGINT AS total_retrievals FROM t"""
)
def retrieval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.query_vectors(spark, sf_dir).join(R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("description")), "query_id")
    d = R.database_vectors(spark, sf_dir).withColumn("path", R.path(F.col("db_id")))
    return retrieval.statistics(retrieval.retrieve(q.withColumn("image_path", R.path(F.col("query_id"))), d, RetrievalConfig(), 3))


_REPORT = (
    _ranked(_L2, "ASC", 5)
    + """, r AS (
  SELECT query_id, list(db_id ORDER BY rank) AS preds, list(ql = dl ORDER BY rank) AS correct FROM p GROUP BY 1
), k AS (SELECT query_id, list(db_id ORDER BY db_id) AS positives FROM q JOIN d USING (label) GROUP BY 1)
SELECT r.query_id, array_to_string(preds, ',') AS preds, array_to_string(correct, ',') AS correct, array_to_string(positives, ',') AS positives
FROM r JOIN k USING (query_id)"""
)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.nearest(R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir), 5)
    return metrics.report(found, _truth(spark, sf_dir))


def _flat(reports: DataFrame) -> DataFrame:
    s = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return reports.select("query_id", s("preds"), s("correct"), s("positives"))


@query(_REPORT)
def pred_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_reports(spark, sf_dir))


@query(_REPORT + " WHERE NOT correct[1]")
def wrong_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(metrics.wrong_only(_reports(spark, sf_dir)))


@query(_ranked(_L2, "ASC", 20) + " SELECT query_id, db_id FROM p INTERSECT SELECT query_id, db_id FROM q JOIN d USING (label)")
def positives_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.nearest(R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir), 20)
    return found.select("query_id", "db_id").intersect(_truth(spark, sf_dir))


@query(_ranked(_L2, "ASC", 5) + " SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM p WHERE ql = dl)")
def queries_without_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.nearest(R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir), 5)
    hit = found.join(_truth(spark, sf_dir), ["query_id", "db_id"], "left_semi").select("query_id").distinct()
    return R.query_vectors(spark, sf_dir).select("query_id").join(hit, "query_id", "left_anti")


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptors, every third a second time under another id."""
    e = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    again = e.where("image_id % 3 = 0").withColumn("image_id", F.col("image_id") + 1000000)
    return e.unionByName(again).withColumn("path", R.path(F.pmod("image_id", F.lit(1000000))))


_COPIED = "c AS (SELECT vec_id AS image_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE vec_id % 3 = 0)"


@query(f"WITH {_COPIED} SELECT min(image_id) AS image_id FROM c GROUP BY embedding")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(_copied(spark, sf_dir)).select("image_id")


@query()
def dedup_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.windowed(_copied(spark, sf_dir)).select("image_id")


@query(f"WITH {_COPIED} SELECT min(image_id) AS image_id FROM c GROUP BY embedding")
def dedup_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near(_copied(spark, sf_dir)).select("image_id")


@query(f"WITH {_COPIED} SELECT count(*) AS n, array_to_string(list(image_id ORDER BY image_id), ',') AS ids FROM c GROUP BY embedding HAVING count(*) > 1")
def duplicate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicates(_copied(spark, sf_dir)).select("n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    f"""WITH {_COPIED} SELECT count(*) AS total, count(DISTINCT embedding) AS unique_features, count(DISTINCT image_id % 1000000) AS unique_paths, 0::BIGINT AS incomplete,
count(*) - count(DISTINCT embedding) AS duplicate_features, count(*) - count(DISTINCT image_id % 1000000) AS duplicate_paths FROM c"""
)
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.integrity(_copied(spark, sf_dir))


@query(
    f"""
WITH {R.SQL_VECTORS}, t AS (SELECT vec_id, embedding, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings), m AS (
  SELECT vec_id, v, list_sum(v) / len(v) AS mean, list_min(v) AS lo, list_max(v) AS hi, ({R.SQL_NORM.format(a="embedding")}) AS norm FROM t)
SELECT vec_id, round(mean, 6) AS mean, round(sqrt(list_sum(list_transform(v, lambda z: (z - mean) * (z - mean))) / (len(v) - 1)), 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max,
  round(norm, 6) AS norm, round(list_sum(list_transform(v, lambda z: z / greatest(norm, 1e-12))), 6) AS unit_sum,
  round(pow(list_sum(list_transform(v, lambda z: pow(greatest(z, 1e-6), 3.0))) / len(v), 1.0 / 3.0), 6) AS gem, (list_position(v, hi) - 1)::INT AS argmax FROM m"""
)
def vector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    r = lambda c, n: F.round(c, 6).alias(n)
    unit = F.aggregate(vectors.normalised(v, least=1e-12), F.lit(0.0), lambda a, x: a + x)
    return R.table(spark, sf_dir, "embeddings").select(
        "vec_id", r(vectors.mean(v), "mean"), r(vectors.deviation(v), "std"), r(F.array_min(vectors.as_double(v)), "min"), r(F.array_max(vectors.as_double(v)), "max"),
        r(vectors.norm(v), "norm"), r(unit, "unit_sum"), r(vectors.gem(v), "gem"), vectors.argmax(v).alias("argmax"),
    )


@query(
    f"""
WITH {R.SQL_VECTORS} SELECT query_id, db_id, round({_DOT} / greatest(({R.SQL_NORM.format(a="q.embedding")}) * ({R.SQL_NORM.format(a="d.embedding")}), 1e-8), 6) AS cosine,
  round(30.0 * ({_DOT} / greatest(({R.SQL_NORM.format(a="q.embedding")}) * ({R.SQL_NORM.format(a="d.embedding")}), 1e-8) - CASE WHEN q.label = d.label THEN 0.4 ELSE 0.0 END), 6) AS logit
FROM q, d"""
)
def cosface_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.cosface_logits(R.query_vectors(spark, sf_dir), R.database_vectors(spark, sf_dir), digits=6)


@query("SELECT doc_id, coalesce(length(text) > 300, false) AS too_long_clip, coalesce(length(text) > 2000, false) AS too_long_blip FROM documents")
def text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select("doc_id", text.too_long(F.col("text"), 300).alias("too_long_clip"), text.too_long(F.col("text"), 2000).alias("too_long_blip"))


