"""Connected components by hooking and pointer jumping over written tables; nothing comes to the driver but a flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Rows of edges and labels to a task: rounds over a small graph are not cut into as many tasks as the corpus.
ROWS_PER_FILE = 100_000


def components(edges: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(id, comp) for each end of an edge (a, b), comp being the smallest id reachable; label: components known before, which the edges join.

    Each round hooks every component to its smallest neighbour, follows the pointers twice, and contracts the edges. Sums
    and minima are formed before rows are moved, so a hub with any number of edges is one row for each task."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = written(edges)
    parts = 4 + (edges.count() + (0 if label is None else label.count())) // ROWS_PER_FILE
    kept = lambda df: written(df.coalesce(parts))
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if label is None:
        label = ends.withColumn("comp", F.col("id"))
        work = edges
    else:
        label = kept(label.select("id", "comp").unionByName(ends.join(label, "id", "left_anti").withColumn("comp", F.col("id"))))
        work = _relabelled(edges, label, parts)
    while not work.isEmpty():
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
        for _ in range(2):
            up = parent.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
            parent = parent.join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        parent = kept(parent)
        up = parent.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        label = kept(label.join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")))
        work = _relabelled(work, parent, parts)
    return label


def _relabelled(edges: DataFrame, label: DataFrame, parts: int) -> DataFrame:
    """The edges between components."""
    a = label.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    b = label.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    mapped = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    return written(mapped.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(parts))
