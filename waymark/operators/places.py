"""Places: cells of position and heading are classes, and classes that never touch form groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PlaceConfig
from ..functions import numbers


def classified(images: DataFrame, c: PlaceConfig = PlaceConfig()) -> DataFrame:
    """images (image_id, e, n, heading) with class_id and group_id: floors, and non-negative remainders of them."""
    e, n, h = numbers.cell(F.col("e"), c.m), numbers.cell(F.col("n"), c.m), numbers.cell(F.col("heading"), c.alpha)
    group = F.struct(numbers.group_index(e, c.m, c.n).alias("ge"), numbers.group_index(n, c.m, c.n).alias("gn"), numbers.group_index(h, c.alpha, c.l).alias("gh"))
    return images.withColumn("class_id", F.struct(e.alias("ce"), n.alias("cn"), h.alias("ch"))).withColumn("group_id", group)


def kept_classes(placed: DataFrame, c: PlaceConfig = PlaceConfig()) -> DataFrame:
    """(class_id, group_id, n_images, first_image, images) of the classes with enough images."""
    each = placed.groupBy("class_id", "group_id").agg(F.count(F.lit(1)).alias("n_images"), F.min("image_id").alias("first_image"), F.sort_array(F.collect_list("image_id")).alias("images"))
    return each.where(F.col("n_images") >= c.min_images_per_class)


def class_sizes(placed: DataFrame, c: PlaceConfig = PlaceConfig()) -> DataFrame:
    """The same without the lists, which a place of many images would make long."""
    return placed.groupBy("class_id", "group_id").agg(F.count(F.lit(1)).alias("n_images"), F.min("image_id").alias("first_image")).where(F.col("n_images") >= c.min_images_per_class)


def groups(classes: DataFrame) -> DataFrame:
    """(group_id, group_index, n_classes, n_images, classes): groups numbered by the first image of a kept class; classes in order."""
    from ..sources.images import numbered

    each = classes.groupBy("group_id").agg(F.min("first_image").alias("first_image"), F.count(F.lit(1)).alias("n_classes"), F.sum("n_images").alias("n_images"), F.sort_array(F.collect_set("class_id")).alias("classes"))
    return numbered(each, "first_image", "group_index").drop("first_image")


def kept_images(placed: DataFrame, c: PlaceConfig = PlaceConfig()) -> DataFrame:
    """The images of classes that are kept."""
    return placed.join(class_sizes(placed, c).select("class_id"), "class_id", "left_semi")
