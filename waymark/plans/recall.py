"""Recall evaluation: positives within a radius, nearest descriptors, recall at k, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RecallConfig
from ..operators import geo, knn, metrics


def positives(queries: DataFrame, database: DataFrame, c: RecallConfig = RecallConfig()) -> DataFrame:
    """(query_id, db_id) of images taken at most the threshold apart."""
    return geo.within_radius(queries, database, c.positive_dist_threshold).select("query_id", "db_id")


def evaluate(queries: DataFrame, database: DataFrame, truth: DataFrame, c: RecallConfig = RecallConfig(), way: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(recalls, predictions) of described queries against the database's descriptors."""
    predictions = knn.nearest(queries, database, max(c.recall_values), way)
    return metrics.recall_at(queries, predictions, truth, c.recall_values), predictions


def reports(predictions: DataFrame, truth: DataFrame, c: RecallConfig = RecallConfig()) -> DataFrame:
    """The first predictions of each query with their flags; only queries whose first is wrong, if so configured."""
    top = predictions.where(F.col("rank") <= c.num_preds_to_save) if c.num_preds_to_save else predictions
    out = metrics.report(top, truth)
    return metrics.wrong_only(out) if c.save_only_wrong_preds else out
