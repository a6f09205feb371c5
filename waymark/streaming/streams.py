"""Structured Streaming forms of what the batch operators do. Extensions: the batch forms are the ones of record.

Every stream takes a checkpoint folder; a restarted query goes on where it was, and sinks that append are idempotent by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import knn


def persisted(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch as a folder of its own below path, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={i}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_meters(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(meter, start, avg, max, n) of (ts, meter, value) in event-time windows; what comes later than `late` is dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy("meter", window.alias("w")).agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))
    return out.select("meter", F.col("w.start").alias("start"), "avg", "max", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(meter, start, end, n): runs of events of a meter without a longer gap."""
    out = stream.withWatermark("ts", late).groupBy("meter", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("meter", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ring_buffer(stream: DataFrame, size: int) -> DataFrame:
    """(meter, n, total, latest): a bounded buffer of each meter's last values, kept as state; order is that of ts within a batch."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, values = state.get if state.exists else (0, [])
        last = pd.DataFrame({"ts": [], "value": []})
        for frame in frames:  # a group comes in several frames, in no order
            n += len(frame)
            last = (pd.concat([last, frame[["ts", "value"]]]) if len(last) else frame[["ts", "value"]]).sort_values("ts", kind="stable").tail(size)
        values = (list(values) + last["value"].tolist())[-size:]
        state.update((n, values))
        yield pd.DataFrame({"meter": [key[0]], "n": [n], "total": [float(sum(values))], "latest": [float(values[-1])]})

    return stream.groupBy("meter").applyInPandasWithState(step, "meter string, n long, total double, latest double", "n long, values array<double>", "update", "NoTimeout")


def searched(stream: DataFrame, database: DataFrame, k: int, path: str, checkpoint: str, metric: str = "cosine") -> StreamingQuery:
    """Queries that arrive, against a static database: each micro-batch is a search of its own."""

    def write(batch: DataFrame, i: int) -> None:
        knn.search(batch, database, metric, k).write.mode("overwrite").parquet(f"{path}/batch={i}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
