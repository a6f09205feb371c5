"""Relations derived from the test tables with integer arithmetic that Spark and DuckDB agree on, in both languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stated query set of every search: the rows whose id is divisible by this, against all rows.
EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def east(k: Column) -> Column:
    return F.lit(543000) + F.pmod(k * 7919, F.lit(2000)) + F.lit(0.25)


def north(k: Column) -> Column:
    return F.lit(4178000) + F.pmod(k * 104729, F.lit(2000)) + F.lit(0.5)


def heading(k: Column) -> Column:
    return F.pmod(k * 37, F.lit(360))


def path(k: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit("/data/images/@0"), s(F.lit(543000) + F.pmod(k * 7919, F.lit(2000))), F.lit(".25@"), s(F.lit(4178000) + F.pmod(k * 104729, F.lit(2000))),
        F.lit(".50@10@S@037.77166@-122.50995@"), s(k), F.lit("@@"), s(heading(k)), F.lit("@@@@201311@@.jpg"),
    )


SQL_EAST = "543000 + ({k} * 7919) % 2000 + 0.25::DOUBLE"
SQL_NORTH = "4178000 + ({k} * 104729) % 2000 + 0.5::DOUBLE"
SQL_PATH = (
    "'/data/images/@0' || (543000 + ({k} * 7919) % 2000) || '.25@' || (4178000 + ({k} * 104729) % 2000) || "
    "'.50@10@S@037.77166@-122.50995@' || {k} || '@@' || (({k} * 37) % 360) || '@@@@201311@@.jpg'"
)


def sql_points(name: str, source: str, key: str, where: str = "true", id_: str = "id") -> str:
    """A CTE (id, e, n, heading, path)."""
    return (
        f"{name} AS (SELECT {key} AS {id_}, {SQL_EAST.format(k=key)} AS e, {SQL_NORTH.format(k=key)} AS n, (({key} * 37) % 360)::DOUBLE AS heading, "
        f"{SQL_PATH.format(k=key)} AS path FROM {source} WHERE {where})"
    )


def points(spark: SparkSession, sf_dir: str, source: str, key: str, where: str = "true", id_: str = "id") -> DataFrame:
    t = table(spark, sf_dir, source).where(where)
    return t.select(F.col(key).alias(id_), east(F.col(key)).cast("double").alias("e"), north(F.col(key)).cast("double").alias("n"), heading(F.col(key)).cast("double").alias("heading"), path(F.col(key)).alias("path"))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "orders", "o_orderkey", f"o_orderkey % {EVERY} = 0", "query_id")


def database_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "customer", "c_custkey", "true", "db_id")


SQL_QUERY_POINTS = sql_points("q", "orders", "o_orderkey", f"o_orderkey % {EVERY} = 0", "query_id")
SQL_DATABASE_POINTS = sql_points("d", "customer", "c_custkey", "true", "db_id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def database_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("db_id"), "embedding", "label")


SQL_VECTORS = (
    f"q AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % {EVERY} = 0), "
    "d AS (SELECT vec_id AS db_id, embedding, label FROM embeddings)"
)
SQL_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
SQL_L1 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))"
SQL_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
SQL_NORM = "sqrt(list_sum(list_transform({a}, lambda z: z::DOUBLE * z::DOUBLE)))"
