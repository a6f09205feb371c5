"""What is written. Tables stay in as many files as tasks; one file is made only where a reader needs one."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header and empty fields for nulls."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, quote='"', escape='"', nullValue="", emptyValue="").csv(path)


def versioned(path: str, now: datetime | None = None) -> str:
    """path with a time, so that nothing is overwritten."""
    return f"{path.rstrip('/')}_{(now or datetime.now(UTC)):%Y%m%d_%H%M%S}"


def backup(spark: SparkSession, path: str, now: datetime | None = None) -> str:
    """Copies a file or folder beside itself, under a name with the time; returns it. Nothing is overwritten."""
    to = f"{path.rstrip('/')}.backup_{(now or datetime.now(UTC)):%Y%m%d_%H%M%S}"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(path), hadoop.Path(to)
    files = a.getFileSystem(conf)
    if files.exists(b) or not hadoop.FileUtil.copy(files, a, files, b, False, False, conf):
        raise FileExistsError(to)
    return to


def request(uri: Column, prompt: Column, mime: str = "image/jpeg") -> Column:
    """The JSON of one request, properly escaped."""
    file = F.struct(F.struct(uri.alias("file_uri"), F.lit(mime).alias("mime_type")).alias("file_data"))
    parts = F.array(F.to_json(file), F.to_json(F.struct(prompt.alias("text"))))
    return F.concat(F.lit('{"request":{"contents":[{"role":"user","parts":['), F.array_join(parts, ","), F.lit("]}]}}"))


def requests(images: DataFrame, path: str, uri: str, prompt: str) -> None:
    """A line of JSON for each image."""
    images.select(request(F.col(uri), F.lit(prompt)).alias("value")).write.mode("overwrite").text(path)


def json_arrays(df: DataFrame, path: str) -> None:
    """An array of objects a file, as annotation files are, in as many files as tasks; sorted rows stay sorted over the files' names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        begun = False
        for batch in batches:
            rows = [("," if begun or i else "") + x for i, x in enumerate(batch["value"])]
            begun = begun or bool(rows)
            yield pd.DataFrame({"value": pd.Series(rows, dtype=object)})
        yield pd.DataFrame({"value": ["]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def report(query: Column, predictions: Column, positives: Column | None = None) -> Column:
    """The text report of a query: its path, its predictions' paths and its positives' paths."""
    parts = [F.lit("Query path:"), F.concat(query, F.lit("\n")), F.lit("Predictions paths:"), F.concat(F.array_join(predictions, "\n"), F.lit("\n"))]
    if positives is not None:
        parts += [F.lit("Positives paths:"), F.concat(F.array_join(positives, "\n"), F.lit("\n"))]
    return F.concat_ws("\n", *parts)


def search_json(results: DataFrame) -> DataFrame:
    """(query, value): the JSON of each query's results, best first. Results: (query, rank, path, similarity)."""
    found = F.array_sort(F.collect_list(F.struct("rank", "path", "similarity")))
    return results.groupBy("query").agg(found.alias("results"), F.count(F.lit(1)).alias("top_k")).select("query", F.to_json(F.struct("query", "top_k", "results")).alias("value"))


def descriptors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Lines of JSON, after those that are there."""
    df.write.mode("append").json(path)
