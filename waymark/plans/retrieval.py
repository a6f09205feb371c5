"""Text-to-image retrieval over a table of descriptions: guard, search, wide result, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import encoders
from ..config import RetrievalConfig
from ..functions import paths, text, vectors
from ..operators import dedup, knn, metrics, reshape
from ..sources import images, sinks, tables


def retrieve(queries: DataFrame, database: DataFrame, c: RetrievalConfig = RetrievalConfig(), k: int | None = None, way: str | None = None) -> DataFrame:
    """One row for each query: its description and coordinates, and k references with path, distance and coordinates.

    queries: (query_id, image_path, description, embedding); database: (db_id, path, embedding). Queries whose text is too long
    stay without references (on_long_text = skip). Missing references are null."""
    k = k or c.default_top_k
    if c.auto_remove_duplicates:
        database = dedup.exact(database, "db_id")
    long = text.too_long(F.col("description"), c.max_chars) if c.on_long_text == "skip" else F.lit(False)
    judged = queries.withColumn("failed", long | F.col("embedding").isNull())
    found = knn.search(judged.where(~F.col("failed")), database, c.similarity_metric, k, c.min_similarity_threshold, c.normalize_features, way)
    refs = database.select("db_id", "path", paths.utm_cascade(F.col("path")).alias("u")).select("db_id", "path", "u.utm_east", "u.utm_north")
    ranked = found.join(refs, "db_id").withColumn("distance", vectors.distance_of(F.col("similarity")))
    wide = reshape.widened(ranked, ["query_id"], k)
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_matches"))
    u = paths.utm_cascade(F.col("image_path"))
    head = judged.select("query_id", F.col("image_path").alias("query_image_path"), F.col("description").alias("query_description"), u["utm_east"].alias("utm_east"), u["utm_north"].alias("utm_north"), "failed")
    return head.join(counts, "query_id", "left").join(wide, "query_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def statistics(results: DataFrame) -> DataFrame:
    return metrics.processing_stats(results)


def history(results: DataFrame, c: RetrievalConfig, k: int) -> DataFrame:
    """A record of each search."""
    return results.select(F.current_timestamp().alias("timestamp"), F.col("query_description").alias("query"), F.lit(k).alias("top_k"), F.col("n_matches").alias("results_count"), F.lit(c.similarity_metric).alias("similarity_metric"), F.lit(c.min_similarity_threshold).alias("min_threshold"))


class Retriever:
    """An image database and its encoder: builds or loads it, searches it, keeps it."""

    def __init__(self, spark: SparkSession, make: Callable[[], encoders.Encoder], config: RetrievalConfig = RetrievalConfig()):
        self.spark, self.make, self.config = spark, make, config
        self.database: DataFrame | None = None

    def build_image_database(self, folder: str) -> DataFrame:
        """(db_id, path, embedding) of a folder's images, ids in the order of the paths; images that cannot be encoded go."""
        found = images.scan(self.spark, folder, self.config.supported_formats)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        content = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
        encoded = encoders.encode(images.numbered(found, name="db_id").join(content, "path"), "content", self.make, "image", "drop")
        self.database = encoded.select("db_id", "path", "embedding")
        if self.config.auto_remove_duplicates:
            self.remove_duplicate_features()
        return self.database

    def remove_duplicate_features(self) -> DataFrame:
        self.database = dedup.exact(self._ready(), "db_id")
        return self.database

    def encode_text(self, queries: DataFrame, column: str = "description") -> DataFrame:
        """queries with an embedding of their text, cut at a word where it is too long."""
        cut = queries.withColumn("_t", text.cut_at_word(F.col(column), self.config.max_chars))
        return encoders.encode(cut, "_t", self.make).drop("_t")

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, rank, db_id, path, similarity) of (query_id, description)."""
        found = knn.search(self.encode_text(queries), self._ready(), self.config.similarity_metric, k or self.config.default_top_k, self.config.min_similarity_threshold, self.config.normalize_features)
        return found.join(self._ready().select("db_id", "path"), "db_id").select("query_id", "rank", "db_id", "path", "similarity")

    def check_integrity(self) -> DataFrame:
        return dedup.integrity(self._ready())

    def save_database(self, path: str) -> None:
        sinks.descriptors(self._ready(), path)

    def load_database(self, path: str) -> DataFrame:
        self.database = tables.descriptors(self.spark, path)
        return self.database

    def _ready(self) -> DataFrame:
        if self.database is None:
            raise ValueError("build or load a database first")
        return self.database
