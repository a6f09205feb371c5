"""Description tables, result tables, text lines and prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths, text


def descriptions(spark: SparkSession, path: str, image_root: str | None = None) -> DataFrame:
    """(image_path, description) of a CSV with a header; malformed lines are skipped."""
    reader = spark.read.schema(schema.DESCRIPTIONS).options(header=True, quote='"', escape='"', multiLine=True, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, encoding="UTF-8")
    out = reader.csv(path)
    return out if image_root is None else out.withColumn("image_path", paths.joined(image_root, F.col("image_path")))


def descriptions_by_hand(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """The same from lines that a CSV reader refuses: the first field, and all that follows it. Lines of one field are skipped.

    Without a delimiter, that of comma, semicolon, tab and bar is taken which the header has most often."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if delimiter is None:
        head = lines.orderBy("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).first()
        delimiter = max(",;\t|", key=lambda c: head.value.count(c)) if head else ","
    header = text.unquoted(F.trim(F.element_at(F.split("value", "[" + ("\\t" if delimiter == "\t" else delimiter) + "]", 2), 1)))
    pattern = "\\t" if delimiter == "\t" else "[" + delimiter + "]"
    fields = F.split("value", pattern, 2)
    rows = lines.where(~(F.lower(header) == "image_path")).where(F.size(fields) == 2)
    return rows.select(text.unquoted(F.trim(fields[0])).alias("image_path"), text.unquoted(F.trim(fields[1])).alias("description"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """A wide result table; types follow the column names, so no pass infers them."""
    header = spark.read.option("header", True).csv(path).columns
    ddl = ", ".join(f"`{c}` " + ("DOUBLE" if c.endswith(("_distance", "utm_east", "utm_north")) else "STRING") for c in header)
    return spark.read.schema(ddl).option("header", True).csv(path)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(fields) of the lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(text.comma_fields(F.col("value")).alias("fields"))


def predictions(spark: SparkSession, path: str, uri_prefix: str = "") -> DataFrame:
    """(image_path, description) of a batch prediction file; lines without an answer are skipped."""
    return prediction_rows(spark.read.schema(schema.PREDICTION_LINE).json(path), uri_prefix)


def prediction_rows(lines: DataFrame, uri_prefix: str = "") -> DataFrame:
    """The same of parsed lines."""
    answer = F.get(F.get(F.col("response.candidates"), F.lit(0))["content"]["parts"], F.lit(0))["text"]
    uri = F.get(F.get(F.col("request.contents"), F.lit(0))["parts"], F.lit(0))["file_data"]["file_uri"]
    out = lines.select(uri.alias("image_path"), answer.alias("description")).where("image_path is not null and description is not null")
    return out.withColumn("image_path", F.replace("image_path", F.lit(uri_prefix), F.lit(""))) if uri_prefix else out


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or ValueError with what it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """A descriptor table that sinks.descriptors wrote."""
    return spark.read.parquet(path)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; build() makes it if it is not there."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
