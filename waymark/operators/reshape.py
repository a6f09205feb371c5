"""Between rows for each rank and columns for each rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("path", "distance", "utm_east", "utm_north")


def widened(ranked: DataFrame, keys: list[str], k: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each key with reference_{i}_{field}; ranks that are missing are null. One aggregation, no pivot job."""
    at = [F.max(F.when(F.col("rank") == i, F.col(f))).alias(f"reference_{i}_{f}") for i in range(1, k + 1) for f in fields]
    return ranked.groupBy(*keys).agg(*at)


def lengthened(wide: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row for each key and rank; ranks without a path go."""
    k = available(wide.columns)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), *[F.col(f"reference_{i}_{f}").alias(f) for f in fields]) for i in range(1, k + 1)]))
    return wide.select(*keys, each.alias("r")).select(*keys, "r.*").where(F.col("path").isNotNull() & (F.trim("path") != ""))


def available(columns: list[str]) -> int:
    """How many ranks without a gap the columns hold."""
    i = 0
    while f"reference_{i + 1}_path" in columns:
        i += 1
    return i


def has_reference(wide: DataFrame) -> DataFrame:
    """Rows with a path at any rank."""
    refs = F.array(*[F.col(f"reference_{i}_path") for i in range(1, available(wide.columns) + 1)])
    return wide.where(F.exists(refs, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))


def replaced_paths(df: DataFrame, old: str, new: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the table with old replaced literally, the count of changed rows for each column). Null stays null and is no change."""
    from ..functions import paths

    cols = columns or paths.path_columns(df.columns)
    out = df.select(*[paths.replaced(F.col(c), old, new).alias(c) if c in cols else F.col(c) for c in df.columns])
    wide = df.agg(*[F.sum(F.when(paths.replaced(F.col(c), old, new) != F.col(c), 1).otherwise(0)).cast("long").alias(c) for c in cols])
    counts = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("changed")) for c in cols])).alias("x")).select("x.*")
    return out, counts


def change_sample(df: DataFrame, old: str, new: str, columns: list[str], rows: int = 5, most_columns: int = 3) -> DataFrame:
    """(column, before, after): the first changes of the first columns, in the order of the values."""
    from ..functions import paths

    out = None
    for c in columns[:most_columns]:
        part = df.select(F.lit(c).alias("column"), F.col(c).alias("before"), paths.replaced(F.col(c), old, new).alias("after")).where("before <> after").orderBy("before").limit(rows)
        out = part if out is None else out.unionByName(part)
    return out


def pooled(vectors: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """(group, dim, mean, max) of the vectors of each group: pooling over tokens or frames. Sums and maxima are formed before rows move."""
    each = vectors.select(group, F.posexplode(F.col(embedding).cast("array<double>")).alias("dim", "_x"))
    return each.groupBy(group, "dim").agg(F.avg("_x").alias("mean"), F.max("_x").alias("max"))


def tiles(images: DataFrame, size: int = 448, most: int = 12, thumbnail: bool = True) -> DataFrame:
    """(image, tile, left, top, right, bottom): the boxes of each image's grid; a thumbnail is tile -1 where there is more than one."""
    from ..functions import numbers

    g = images.withColumn("_g", numbers.tile_ratio(F.col("width"), F.col("height"), size, most))
    boxes = g.withColumn("_b", numbers.tile_boxes(F.col("_g"), size))
    out = boxes.select("image_id", F.posexplode("_b").alias("tile", "b")).select("image_id", "tile", "b.*")
    if not thumbnail:
        return out
    whole = boxes.where(F.size("_b") > 1).select("image_id", F.lit(-1).alias("tile"), F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(size).alias("right"), F.lit(size).alias("bottom"))
    return out.unionByName(whole)
