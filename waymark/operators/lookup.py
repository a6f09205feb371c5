"""Joins by key and position, dense ids, caption maps, answer weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row of each key. min_by is pre-aggregated, so a hot key is one row for each task."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def describe(images: DataFrame, descriptions: DataFrame, order: list[str], missing: str | None = "") -> DataFrame:
    """images with the first description of their path; missing: what others get, or None for an error."""
    first = first_per_key(descriptions.select("image_path", "description", *[c for c in order if c not in ("image_path", "description")]), "image_path", order).select("image_path", "description")
    out = images.join(first, images["path"] == first["image_path"], "left").drop("image_path")
    if missing is not None:
        return out.withColumn("description", F.coalesce("description", F.lit(missing)))
    return out.withColumn("description", F.when(F.col("description").isNull(), F.raise_error(F.concat(F.lit("no description of "), F.col("path")))).otherwise(F.col("description")))


def by_position(left: DataFrame, right: DataFrame, position: str = "pos", strict: bool = True) -> DataFrame:
    """Row i of one with row i of the other, by an explicit position; strict: only positions that both have."""
    return left.join(right, position, "inner" if strict else "left")


def dense_ids(df: DataFrame, key: str, pos: str, name: str) -> DataFrame:
    """name: keys numbered from 0 by first appearance. Only one row for each key is ordered."""
    first = df.groupBy(key).agg(F.min(pos).alias("_first"))
    ids = _numbered(first, "_first", name).select(key, name)
    return df.join(ids, key)


def _numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    from ..sources.images import numbered

    return numbered(df, order, name)


def caption_maps(df: DataFrame, pos: str, captions: str) -> tuple[DataFrame, DataFrame]:
    """(images, texts): img_id by position, txt_id counted through all captions in order."""
    images = _numbered(df, pos, "img_id")
    texts = images.select("img_id", F.posexplode(captions).alias("_k", "caption"))
    texts = texts.withColumn("_o", F.struct("img_id", "_k"))
    return images.drop(captions, pos), _numbered(texts, "_o", "txt_id").select("txt_id", "img_id", "caption")


def text_ids(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(img_id, txt_id, text): img_id numbers the keys, txt_id all rows, both from 0 in order."""
    ids = _numbered(df.select(key).distinct(), key, "img_id")
    rows = df.withColumn("_o", F.struct(key, order))
    return _numbered(rows, "_o", "txt_id").join(ids, key).select("img_id", "txt_id", text)


def answer_weights(df: DataFrame, question: str, answers: str) -> DataFrame:
    """(question, answer, weight): each answer's share of a question's answers."""
    each = df.select(question, F.explode(answers).alias("answer"), (F.lit(1.0) / F.size(answers)).alias("_w"))
    return each.groupBy(question, "answer").agg(F.sum("_w").alias("weight"))


def collated(df: DataFrame, group: str, order: str, values: str) -> DataFrame:
    """(group, flat, lengths): ragged arrays laid end to end in order, and their lengths."""
    listed = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, values))).alias("_l"))
    return listed.select(group, F.flatten(F.transform("_l", lambda x: x[values])).alias("flat"), F.transform("_l", lambda x: F.size(x[values])).alias("lengths"))


def repeated(df: DataFrame, times: str, name: str = "copy") -> DataFrame:
    """Each row as often as it says, with the number of the copy."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(times) - 1))).where(F.col(times) > 0)


def same_index_pairs(df: DataFrame, index: str, row: str, batch: str) -> DataFrame:
    """(i, j): pairs of rows of a batch with one index, themselves included; the mask of positives of contrastive batches.

    Pairs are formed within a batch only, so they grow with the rows times a batch's size, however hot an index is."""
    side = lambda name: df.select(F.col(batch).alias("_b"), F.col(index).alias("_x"), F.col(row).alias(name))
    return side("i").join(side("j"), ["_b", "_x"]).select("i", "j")


def merge_keep_first(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of result parts; of equal keys the row of the first part, then of the first position (a column pos)."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return first_per_key(both, key, ["_part", "pos"]).drop("_part")


def best_by(df: DataFrame, order: str, value: str) -> DataFrame:
    """Each row with the best value so far, and whether it is a new best. The window is over one row for each epoch."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.max(value).over(w)
    return df.withColumn("best", F.greatest(F.col(value), before)).withColumn("is_best", before.isNull() | (F.col(value) > before))
