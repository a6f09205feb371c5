"""Annotation files of caption, retrieval, reasoning, question and video sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths, text
from ..operators import lookup
from . import images


def read(spark: SparkSession, kind: str, *files: str, lines: bool = False) -> DataFrame:
    """The rows of one or more files of a kind (schema.ANNOTATIONS); arrays of objects, or an object a line."""
    return spark.read.schema(schema.ANNOTATIONS[kind]).option("multiLine", not lines).json(list(files))


def caption_train(spark: SparkSession, path: str, image_root: str, prompt: str = "", max_words: int = 30) -> DataFrame:
    """(image, caption, img_id): captions normalised after the prompt, ids dense by first appearance."""
    rows = read(spark, "caption_train", path).withColumn("pos", images.position())
    rows = lookup.dense_ids(rows, "image_id", "pos", "img_id")
    return rows.select(paths.joined(image_root, F.col("image")).alias("image"), text.with_prompt(text.caption(F.col("caption"), max_words), prompt).alias("caption"), "img_id")


def retrieval_eval(spark: SparkSession, path: str, image_root: str, max_words: int = 30) -> tuple[DataFrame, DataFrame]:
    """(images, texts): (img_id, image) and (txt_id, img_id, caption) in the file's order."""
    rows = read(spark, "retrieval_eval", path).withColumn("pos", images.position())
    rows = rows.withColumn("caption", F.transform("caption", lambda c: text.caption(c, max_words)))  # before rows move: what is left is shorter
    pictures, texts = lookup.caption_maps(rows, "pos", "caption")
    return pictures.withColumn("image", paths.joined(image_root, F.col("image"))), texts


def caption_eval(spark: SparkSession, path: str, image_root: str) -> DataFrame:
    """(image, img_id): the id is the number in the name."""
    return read(spark, "caption_eval", path).select(paths.joined(image_root, F.col("image")).alias("image"), paths.coco_id(F.col("image")).alias("img_id"))


def nocaps(spark: SparkSession, path: str, image_root: str) -> DataFrame:
    return read(spark, "nocaps", path).select(paths.joined(image_root, F.col("image")).alias("image"), "img_id")


def nlvr(spark: SparkSession, path: str, image_root: str, max_words: int = 40) -> DataFrame:
    """(image0, image1, sentence, label)."""
    return nlvr_rows(read(spark, "nlvr", path), image_root, max_words)


def nlvr_rows(rows: DataFrame, image_root: str = "", max_words: int = 40) -> DataFrame:
    both = [paths.joined(image_root, F.get("images", F.lit(i))).alias(f"image{i}") for i in (0, 1)]
    return rows.select(*both, text.caption(F.col("sentence"), max_words).alias("sentence"), F.when(F.col("label") == "True", 1).otherwise(0).alias("label"))


def vqa(spark: SparkSession, *files: str, roots: dict[str, str], max_words: int = 50) -> DataFrame:
    """(dataset, image, question_id, question, answer): the root follows the set; answers stay as JSON (a list, or one string)."""
    root = F.lit(None).cast("string")
    for name, folder in roots.items():
        root = F.when(F.col("dataset") == name, paths.joined(folder, F.col("image"))).otherwise(root)
    return read(spark, "vqa", *files).select("dataset", root.alias("image"), "question_id", text.question(F.col("question"), max_words).alias("question"), "answer")


def pretrain(spark: SparkSession, files: list[str], shards: list[str] = (), epoch: int = 0, max_words: int = 30) -> DataFrame:
    """All files, and the shard whose turn it is in this epoch."""
    chosen = [*files, *([shards[epoch % len(shards)]] if shards else [])]
    return read(spark, "pretrain", *chosen).select("image", text.caption(F.col("caption"), max_words).alias("caption"))


def video(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(video, caption, txt_id) of an object a line."""
    rows = images.numbered(read(spark, "video", path, lines=True).withColumn("_o", images.position()), "_o", "txt_id")
    return rows.select(F.concat(paths.joined(root, F.col("clip_name")), F.lit(".mp4")).alias("video"), "caption", "txt_id")
