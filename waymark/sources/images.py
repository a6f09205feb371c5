"""Image relations from folders and manifests. File bytes are never read: only the path column is selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..session import scratch

#: Extensions of the recursive scan, and of the scan with six.
COMMON = (".jpg", ".jpeg", ".png")
ALL = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = COMMON, recursive: bool = True, case_sensitive: bool = False, require: bool = True) -> DataFrame:
    """(path) of the images below a folder, each once; files without a byte are none. require: FileNotFoundError if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        found = files.load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(folder) from e
        raise
    test = F.lit(False)
    for e in extensions:
        test = test | (F.col("path").endswith(e) if case_sensitive else F.lower("path").endswith(e))
    found = found.where(test).distinct()
    if require and found.isEmpty():
        raise FileNotFoundError(f"no images in {folder}")
    return found


def position() -> Column:
    """Where a row of a file source stands: its file, its split, its place there. Only on what spark.read gives."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def manifest(spark: SparkSession, listing: str, folder: str) -> DataFrame:
    """(image_id, path) of text that names one image a line, in the file's order; blank lines count but give no row."""
    lines = numbered(spark.read.text(listing).withColumn("_o", position()), "_o")
    return lines.where(F.trim("value") != "").select("image_id", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("value")).alias("path"))


def numbered(images: DataFrame, order: str = "path", name: str = "image_id") -> DataFrame:
    """Dense ids from 0 in the order of a column.

    Ranges are sorted in parallel; a range's ids start after the counts of the ranges before it, so no task sees all rows.
    Rows are stored with their range and their place in it: the counts and the rows read the same ranges, which two
    evaluations of one plan need not have (bounds are sampled, and adaptive execution merges ranges by their bytes)."""
    spark, path = images.sparkSession, scratch(images.sparkSession)
    ranged = images.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    local = ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    local = local.withColumn("_i", F.col("_m") - F.shiftleft(F.col("_p"), 33)).drop("_m")
    local.write.parquet(path)
    local = spark.read.schema(local.schema).parquet(path)
    counts = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return local.join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_b")).cast("long")).drop("_p", "_i", "_b")


def with_coordinates(images: DataFrame, path: str = "path", pattern: str = paths.STRICT, keep_unparsed: bool = False) -> DataFrame:
    """Coordinates of the file names; rows without them go unless kept."""
    utm = paths.utm_strict(paths.basename(F.col(path)), pattern)
    out = images.withColumn("_u", utm).withColumn("utm_east", F.col("_u.utm_east")).withColumn("utm_north", F.col("_u.utm_north")).drop("_u")
    return out if keep_unparsed else out.where(F.col("utm_east").isNotNull() & F.col("utm_north").isNotNull())


def first_existing(wanted: DataFrame, found: DataFrame, path: str = "path", folder: str = "/", home: str = "~") -> DataFrame:
    """wanted with `existing`: the first of the path's alternatives that is a path of found (a scan), or null. Equal paths have equal results."""
    each = wanted.select(path).distinct().select(F.col(path).alias("_w"), F.posexplode(paths.alternatives(F.col(path), folder, home)).alias("_k", "_p"))
    there = each.join(found.select(F.col("path").alias("_p")).distinct(), "_p").groupBy("_w").agg(F.min_by("_p", "_k").alias("existing"))
    return wanted.join(there, F.col(path) == F.col("_w"), "left").drop("_w")


def relative(images: DataFrame, folder: str, path: str = "path") -> DataFrame:
    return images.withColumn(path, paths.relative(F.col(path), folder))


def section(images: DataFrame, start: int, most: int, order: str = "path") -> DataFrame:
    """Rows start to start + most in the order of a column."""
    return images.orderBy(order).offset(start).limit(most)


def database_and_queries(database: DataFrame, queries: DataFrame) -> DataFrame:
    """Both relations under one numbering: queries follow the database. Both have image_id from 0."""
    n = database.agg(F.count(F.lit(1)).alias("_n"))
    moved = queries.crossJoin(F.broadcast(n)).withColumn("image_id", F.col("image_id") + F.col("_n")).drop("_n")
    return database.withColumn("role", F.lit("database")).unionByName(moved.withColumn("role", F.lit("query")))
