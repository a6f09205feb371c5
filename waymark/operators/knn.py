"""Nearest neighbours and similarity search.

Two physical ways with one result: `columns` for a database of up to BROADCAST_ROWS rows, by a limited count, and `blocks`
beyond, whatever the caller names; `blocks` may be named for small ones too. `columns`: the queries' rows meet the broadcast database, all in expressions. `blocks`: the queries, a bounded set taken in blocks, go to
every partition of the database, which multiplies matrices and keeps its k best for each query; the partitions' lists are then
ranked. The second moves k rows for each query and partition, whatever the database's size.

Ties go to the smaller database id. Null embeddings take no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors

#: Queries in a block, and rows of a side that may be broadcast by the columns way.
BLOCK_QUERIES = 4096
BROADCAST_ROWS = 20_000


def rank_best(pairs: DataFrame, k: int, query: str, order: list, name: str = "rank") -> DataFrame:
    """The k first rows of each query. Spark limits each task's groups before the shuffle."""
    w = W.partitionBy(query).orderBy(*order)
    return pairs.withColumn(name, F.row_number().over(w).cast("int")).where(F.col(name) <= k)


def search(queries: DataFrame, database: DataFrame, metric: str = "cosine", k: int = 5, threshold: float = 0.0, normalise: bool = True, way: str | None = None) -> DataFrame:
    """(query_id, rank, db_id, similarity) of (query_id, embedding) against (db_id, embedding).

    The threshold counts only above 0, so it empties the results of metrics that are never positive."""
    if metric not in vectors.SIMILARITY:
        raise ValueError(f"unknown similarity metric: {metric}")
    q, d = queries.select("query_id", F.col("embedding").alias("qe")).where("qe is not null"), database.select("db_id", F.col("embedding").alias("de")).where("de is not null")
    if way not in (None, "columns", "blocks"):
        raise ValueError(f"unknown way: {way}")
    if way == "blocks" or d.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        pairs = _blocks(q, d, metric, k, threshold, normalise)
    else:
        if normalise and metric in ("cosine", "dot_product"):
            q, d = (x.withColumn(c, vectors.normalised(F.col(c), added=1e-8)) for x, c in ((q, "qe"), (d, "de")))
            sim = vectors.dot(F.col("qe"), F.col("de"))
        else:
            sim = vectors.similarity(metric, F.col("qe"), F.col("de"), normalise)
        pairs = q.repartition("query_id").crossJoin(F.broadcast(d)).select("query_id", "db_id", sim.alias("similarity"))
        if threshold > 0:
            pairs = pairs.where(F.col("similarity") >= threshold)
    return rank_best(pairs, k, "query_id", [F.desc("similarity"), F.asc("db_id")]).select("query_id", "rank", "db_id", "similarity")


def nearest(queries: DataFrame, database: DataFrame, k: int = 20, way: str | None = None) -> DataFrame:
    """(query_id, rank, db_id, distance) by squared Euclidean distance; fewer rows where the database has fewer."""
    return search(queries, database, "euclidean", k, way=way).select("query_id", "rank", "db_id", (-F.col("similarity")).alias("distance"))


def _similarities(q: np.ndarray, d: np.ndarray, metric: str, normalise: bool) -> np.ndarray:
    if metric == "manhattan":
        return -np.stack([np.abs(d - x).sum(axis=1) for x in q])
    if metric == "euclidean":
        return 2 * (q @ d.T) - (d * d).sum(axis=1)[None, :] - (q * q).sum(axis=1)[:, None]
    if normalise:
        q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-8)
        d = d / (np.linalg.norm(d, axis=1, keepdims=True) + 1e-8)
    return q @ d.T


def _exact(q: np.ndarray, rows: np.ndarray, metric: str, normalise: bool) -> np.ndarray:
    """The same for pairs of rows, by differences."""
    if metric == "euclidean":
        return -((rows - q) ** 2).sum(axis=1)
    if metric == "manhattan":
        return -np.abs(rows - q).sum(axis=1)
    dots = (q * rows).sum(axis=1)
    if not normalise:
        return dots
    return dots / ((np.linalg.norm(q, axis=1) + 1e-8) * (np.linalg.norm(rows, axis=1) + 1e-8))


def _slack(q: np.ndarray, d: np.ndarray, metric: str, normalise: bool) -> np.ndarray:
    """How far a product may be from the score by differences, for each query: rounding grows with the norms and the dimension."""
    a, b = np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1).max(initial=0.0)
    scale = np.ones(len(q)) if metric in ("cosine", "dot_product") and normalise else (a + b) ** 2
    return 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps * scale


def _first_of_each(group: np.ndarray, k: int) -> np.ndarray:
    """Of rows sorted by group, the first k of each."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group)))) < k


def _blocks(queries: DataFrame, database: DataFrame, metric: str, k: int, threshold: float, normalise: bool) -> DataFrame:
    """Each partition's k best of each query: found by matrix products up to their rounding, scored again by differences."""
    out = None
    for block in _query_blocks(queries):
        ids = np.array([r[0] for r in block])
        q = np.array([r[1] for r in block], np.float64)

        def run(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            at, name, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                if not len(batch):
                    continue
                d = np.stack(batch["de"].to_numpy()).astype(np.float64)
                names = batch["db_id"].to_numpy()
                found = [(at, name, score)]
                for first in range(0, len(q), 256):
                    some = q[first : first + 256]
                    rough = _similarities(some, d, metric, normalise)
                    many = min(len(d), k)
                    floor = np.partition(rough, len(d) - many, axis=1)[:, len(d) - many]
                    i, j = np.nonzero(rough >= (floor - 2 * _slack(some, d, metric, normalise))[:, None])
                    found.append((i + first, names[j], _exact(some[i], d[j], metric, normalise)))
                at, name, score = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((name, -score, at))
                order = order[_first_of_each(at[order], k)]
                at, name, score = at[order], name[order], score[order]
            best = pd.DataFrame({"query_id": ids[at] if len(at) else at, "db_id": name, "similarity": score})
            yield best[best["similarity"] >= threshold] if threshold > 0 else best

        part = database.mapInPandas(run, "query_id long, db_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    return database.sparkSession.createDataFrame([], "query_id long, db_id long, similarity double") if out is None else out


def _query_blocks(queries: DataFrame) -> Iterator[list]:
    block = []
    for row in queries.select(F.col("query_id").cast("long"), "qe").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK_QUERIES:
            yield block
            block = []
    if block:
        yield block
