"""Duplicate descriptors and paths, and checks of a descriptor table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def exact(descriptors: DataFrame, key: str = "image_id", embedding: str = "embedding") -> DataFrame:
    """The first row of each embedding. Grouped by a digest of it, so the rows that move are small."""
    rest = [c for c in descriptors.columns if c != key]
    digest = F.sha2(F.to_json(F.struct(embedding)), 256)
    first = descriptors.groupBy(digest.alias("_d")).agg(F.min(key).alias(key)).select(key)
    return descriptors.join(first, key, "left_semi").select(key, *rest)


def windowed(descriptors: DataFrame, key: str = "image_id", embedding: str = "embedding", last: int = 50) -> DataFrame:
    """The order-dependent way: a row whose fingerprint is new stays; another is compared with the last kept ones.

    Each decision depends on all before it, so one task reads all rows in order; use near() for large tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        seen: set = set()
        kept: list = []
        for batch in batches:
            stay = []
            for v in batch[embedding]:
                x = np.asarray(v, np.float32)
                mark = tuple(np.round(np.array([x.mean(), x.std(ddof=1) if len(x) > 1 else np.nan, x.min(), x.max()], np.float32), 4).tolist())
                new = mark not in seen or not any(len(x) == len(y) and np.all(np.abs(x - y) <= 1e-5 + 1e-5 * np.abs(y)) for y in kept[-last:])
                seen.add(mark)
                if new:
                    kept.append(x)
                    del kept[:-last]
                stay.append(new)
            yield batch[stay]

    return descriptors.coalesce(1).sortWithinPartitions(key).mapInPandas(run, descriptors.schema)


def near(descriptors: DataFrame, key: str = "image_id", embedding: str = "embedding") -> DataFrame:
    """The scalable way: a row goes if one with the same fingerprint and a smaller key is as good as equal.

    Rows that are exactly equal are taken once before they are compared, so a hot fingerprint does not square copies."""
    one = exact(descriptors, key, embedding).select(F.col(key).alias("k"), F.col(embedding).alias("v"), vectors.fingerprint(F.col(embedding)).alias("f"))
    a, b = one.alias("a"), one.alias("b")
    close = a.join(b, (F.col("a.f") == F.col("b.f")) & (F.col("a.k") < F.col("b.k")) & vectors.all_close(F.col("b.v"), F.col("a.v"))).select(F.col("b.k").alias(key)).distinct()
    return exact(descriptors, key, embedding).join(close, key, "left_anti")


def duplicates(descriptors: DataFrame, key: str = "image_id", embedding: str = "embedding") -> DataFrame:
    """(digest, n, ids) of the embeddings that occur more than once."""
    digest = F.sha2(F.to_json(F.struct(embedding)), 256)
    return descriptors.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(key)).alias("ids")).where("n > 1")


def integrity(descriptors: DataFrame, embedding: str = "embedding", path: str = "path") -> DataFrame:
    """One row: rows, distinct embeddings and paths, the duplicates of both, and whether every row has all its parts."""
    digest = F.sha2(F.to_json(F.struct(embedding)), 256)
    out = descriptors.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct(digest).alias("unique_features"), F.count_distinct(path).alias("unique_paths"),
        F.sum((F.col(embedding).isNull() | F.col(path).isNull()).cast("long")).alias("incomplete"),
    )
    return out.withColumn("duplicate_features", F.col("total") - F.col("unique_features")).withColumn("duplicate_paths", F.col("total") - F.col("unique_paths"))
