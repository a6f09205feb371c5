"""Geographic analysis: nearest references of each query as a wide table, and figures over such tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import geo, metrics, reshape


def nearest_references(queries: DataFrame, references: DataFrame, k: int = 5) -> DataFrame:
    """queries: (query_id, query_image_path, e, n); references: (db_id, path, e, n)."""
    found = geo.nearest(queries, references, k).join(references.select("db_id", "path", F.col("e").alias("utm_east"), F.col("n").alias("utm_north")), "db_id")
    wide = reshape.widened(found, ["query_id"], k)
    return queries.select("query_id", "query_image_path", F.col("e").alias("utm_east"), F.col("n").alias("utm_north")).join(wide, "query_id")


def physical_distances(wide: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, rank, physical) from the coordinates, not the stored distances."""
    moved = wide.withColumnsRenamed({"utm_east": "_qe", "utm_north": "_qn"})
    rows = reshape.lengthened(moved, [key, "_qe", "_qn"])
    return rows.select(key, "rank", numbers.distance(F.col("_qe"), F.col("_qn"), F.col("utm_east"), F.col("utm_north")).alias("physical"))


def distance_figures(wide: DataFrame, bins: int = 30, first_ranks: int = 4) -> tuple[DataFrame, DataFrame]:
    """(five numbers and the mean by rank, histograms of the first ranks)."""
    d = physical_distances(wide)
    return metrics.five_numbers(d, "physical", "rank"), metrics.histogram(d.where(F.col("rank") <= first_ranks), "physical", "rank", bins)
