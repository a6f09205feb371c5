"""Command line: `python -m waymark.cli COMMAND ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import paths
from .operators import knn, metrics, places, reshape
from .plans import analysis, recall, retrieval
from .session import session
from .sources import images, sinks, tables


def _points(spark: SparkSession, folder: str, name: str):
    found = images.numbered(images.with_coordinates(images.scan(spark, folder, (".jpg",))), name=name)
    return found.withColumnsRenamed({"utm_east": "e", "utm_north": "n"})


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    """Nearest references of each query as a wide CSV; with --debug only the first queries and ranks are shown."""
    q = _points(spark, a.query, "query_id").withColumnRenamed("path", "query_image_path")
    if a.debug:
        analysis.nearest_references(q.where(F.col("query_id") < a.debug_n), _points(spark, a.reference, "db_id"), a.debug_k).show(truncate=False)
        return
    sinks.csv(analysis.nearest_references(q, _points(spark, a.reference, "db_id"), a.top_k).drop("query_id"), a.output)


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Figures of a wide CSV: five numbers of the distances by rank, and their histograms."""
    wide = tables.require_columns(tables.results(spark, a.csv), ["query_image_path", "utm_east", "utm_north"])
    wide = wide.withColumn("query_id", F.col("query_image_path"))
    numbers, bins = analysis.distance_figures(wide)
    numbers.orderBy("rank").show()
    bins.orderBy("rank", "bin").show(200)


def replace_paths(spark: SparkSession, a: argparse.Namespace) -> None:
    """Replaces a part of the paths in a CSV; --dry-run only counts, --backup keeps a copy of the CSV."""
    df = spark.read.option("header", True).csv(a.csv)
    out, counts = reshape.replaced_paths(df, a.old, a.new, a.columns)
    counts.show(truncate=False)
    if not a.dry_run:
        if a.backup:
            print(sinks.backup(spark, a.csv))
        sinks.csv(out, a.output or sinks.versioned(a.csv.removesuffix(".csv")))


def rebase_paths(spark: SparkSession, a: argparse.Namespace) -> None:
    """Puts the files of path columns below another folder."""
    df = spark.read.option("header", True).csv(a.csv)
    cols = [a.query_col] + ([c for c in df.columns if c.startswith(a.ref_prefix) and c.endswith(a.ref_suffix)] if a.change_references else [])
    sinks.csv(df.withColumns({c: paths.rebased(F.col(c), a.base) for c in cols}), a.output)


def text_to_csv(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lines of comma-separated fields as a CSV."""
    rows = tables.split_lines(spark, a.input)
    width = rows.agg(F.max(F.size("fields"))).first()[0] or 0
    sinks.csv(rows.select(*[F.get("fields", F.lit(i)).alias(f"column_{i + 1}") for i in range(width)]), a.output)


def retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Searches a table of descriptors for a table of encoded queries; a wide CSV and the counts."""
    c = config.resolve(a.preset, a.config, default_top_k=a.top_k, similarity_metric=a.metric, min_similarity_threshold=a.threshold)
    out = retrieval.retrieve(spark.read.parquet(a.queries), tables.descriptors(spark, a.database), c)
    sinks.csv(out.drop("query_id", "failed", "n_matches"), a.output)
    retrieval.statistics(out).show()


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Recall of encoded queries with positions (query_id, embedding, e, n) against a database (db_id, embedding, e, n)."""
    c = config.RecallConfig(a.positive_dist_threshold, tuple(a.recall_values), not a.no_labels, a.num_preds_to_save, a.save_only_wrong_preds)
    q, d = spark.read.parquet(a.queries), spark.read.parquet(a.database)
    if a.no_labels:
        sinks.descriptors(knn.nearest(q, d, max(c.recall_values), "blocks"), a.output)
        return
    truth = recall.positives(q, d, c)
    values, found = recall.evaluate(q, d, truth, c, "blocks")
    values.orderBy("k").show()
    if a.output:
        recall.reports(found, truth, c).write.mode("overwrite").parquet(a.output)


def partition(spark: SparkSession, a: argparse.Namespace) -> None:
    """Classes of the places in a folder, and their groups, as Parquet below a name of the parameters."""
    c = config.PlaceConfig(a.M, a.alpha, a.N, a.L, a.min_images_per_class)
    found = images.numbered(images.scan(spark, a.folder, (".jpg",), case_sensitive=True)).withColumn("_u", paths.utm_fields(F.col("path")))
    points = found.select("image_id", "path", F.col("_u.utm_east").alias("e"), F.col("_u.utm_north").alias("n"), F.col("_u.heading").alias("heading"))
    classes = places.kept_classes(places.classified(points, c), c)
    classes.write.mode("overwrite").parquet(f"{a.output}/{c.cache_name()}/classes")
    places.groups(classes).write.mode("overwrite").parquet(f"{a.output}/{c.cache_name()}/groups")


def requests(spark: SparkSession, a: argparse.Namespace) -> None:
    """A file of requests for a part of a folder's images."""
    part = images.section(images.scan(spark, a.folder), a.start_image, a.max_image)
    sinks.requests(part.select(paths.object_uri(a.bucket, a.prefix, F.col("path")).alias("uri")), a.output, "uri", a.prompt)


def predictions(spark: SparkSession, a: argparse.Namespace) -> None:
    """The answers of a prediction file as a CSV of descriptions."""
    sinks.csv(tables.predictions(spark, a.result, a.uri_prefix), a.output)


def best_epochs(spark: SparkSession, a: argparse.Namespace) -> None:
    """The global averages of a log of meters."""
    metrics.global_average(spark.read.json(a.log)).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="waymark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *options: tuple) -> None:
        p = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        p.set_defaults(run=f)
        for name, extra in options:
            p.add_argument(name, **extra)

    need, flag, num = {"required": True}, {"action": "store_true"}, lambda d: {"type": int, "default": d}
    command(analyze, ("--reference", need), ("--query", need), ("--output", {"default": "results"}), ("--top-k", num(5)), ("--debug", flag), ("--debug-n", num(5)), ("--debug-k", num(3)))
    command(statistics, ("csv", {}))
    command(replace_paths, ("csv", {}), ("old", {}), ("new", {}), ("--columns", {"nargs": "*"}), ("--dry-run", flag), ("--backup", flag), ("--output", {}))
    command(rebase_paths, ("csv", {}), ("base", {}), ("--output", need), ("--query_col", {"default": "query_image_path"}), ("--change_references", flag), ("--ref_prefix", {"default": "reference_"}), ("--ref_suffix", {"default": "_path"}))
    command(text_to_csv, ("input", {}), ("output", {}))
    command(retrieve, ("--queries", need), ("--database", need), ("--output", need), ("--preset", {"choices": list(config.PRESETS)}), ("--config", {}), ("--top_k", {"type": int}), ("--metric", {"choices": config.METRICS}), ("--threshold", {"type": float}))
    command(
        evaluate, ("--queries", need), ("--database", need), ("--output", {}), ("--positive_dist_threshold", {"type": float, "default": 25.0}), ("--recall_values", {"type": int, "nargs": "+", "default": [1, 5, 10, 20]}),
        ("--no_labels", flag), ("--num_preds_to_save", num(0)), ("--save_only_wrong_preds", flag),
    )
    command(partition, ("folder", {}), ("output", {}), ("--M", num(10)), ("--alpha", num(30)), ("--N", num(5)), ("--L", num(2)), ("--min_images_per_class", num(10)))
    command(requests, ("folder", {}), ("output", {}), ("--bucket", need), ("--prefix", {"default": ""}), ("--prompt", need), ("--start_image", num(0)), ("--max_image", num(1000)))
    command(predictions, ("result", {}), ("output", {}), ("--uri_prefix", {"default": ""}))
    command(best_epochs, ("log", {}))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(session("waymark"), args)


if __name__ == "__main__":
    main()
