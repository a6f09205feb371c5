"""Seeded sampling: results depend on the keys and the seed alone, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) from keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def one_of_each(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """A row of each group, chosen evenly."""
    rest = [c for c in df.columns if c != group]
    return df.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(uniform(seed, key), F.col(key))).alias("_r")).select(group, "_r.*").select(*df.columns)


def weighted_one(pairs: DataFrame, query: str, item: str, weight: str, seed: int) -> DataFrame:
    """An item for each query with probability in proportion to its weight (exponential keys); weights of 0 are never chosen."""
    key = -F.log(uniform(seed, query, item)) / F.col(weight)
    return pairs.where(F.col(weight) > 0).groupBy(query).agg(F.min_by(item, F.struct(key, F.col(item))).alias(item))


def negatives(similarities: DataFrame, index: DataFrame, seed: int) -> DataFrame:
    """(i, j): for each i a j of another index, by softmax weights; similarities: (i, j, logit), index: (row, idx)."""
    from .losses import softmax

    a, b = index.select(F.col("row").alias("i"), F.col("idx").alias("xi")), index.select(F.col("row").alias("j"), F.col("idx").alias("xj"))
    w = softmax(similarities, "i", name="w").join(a, "i").join(b, "j").where("xi <> xj")
    return weighted_one(w, "i", "j", "w", seed)


def derangement(df: DataFrame, key: str, seed: int, name: str = "partner") -> DataFrame:
    """Each key with another key, every one once: the successor in a seeded cyclic order. One key alone has itself."""
    from ..sources.images import numbered

    placed = cut(numbered(df.select(key, F.struct(uniform(seed, key), F.col(key)).alias("_u")), "_u", "_at").drop("_u"))
    before = placed.select(F.col(key).alias(name), F.pmod(F.col("_at") - 1, F.lit(max(1, placed.count()))).alias("_at"))
    return placed.join(before, "_at").select(key, name)
