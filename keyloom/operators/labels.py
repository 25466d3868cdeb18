"""Reference texts of image sets: labels found by name, and words of a manifest in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGES, DERIVED = ("jpg", "jpeg", "png", "webp", "bmp"), ("_enhance_contrast", "_upscale_x2")


def stem(path: Column) -> Column:
    """Folder and name of a file without its ending."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def image_files(files: DataFrame) -> DataFrame:
    """Files (path) that are images and no derivatives of others."""
    derived = F.lit(False)
    for d in DERIVED:
        derived = derived | F.lower(stem(F.col("path"))).endswith(d)
    return files.where(ending(F.col("path")).isin(*IMAGES) & ~derived)


def labelled_images(files: DataFrame, labels: DataFrame, folders: tuple[str, str] = ("images", "texts")) -> DataFrame:
    """Images with the text (path, text) beside them or, failing that, at the same place in the mirrored folder: two left joins on the stem."""
    images = image_files(files).select("path", stem(F.col("path")).alias("stem"), F.regexp_replace(stem(F.col("path")), f"(^|/){folders[0]}/", f"$1{folders[1]}/").alias("mirror"))
    texts = labels.groupBy(stem(F.col("path")).alias("stem")).agg(F.min_by("text", "path").alias("text"))
    out = images.join(texts, "stem", "left").join(texts.select(F.col("stem").alias("mirror"), F.col("text").alias("mirrored")), "mirror", "left")
    return out.select("path", F.coalesce("text", "mirrored").alias("text")).where("trim(text) != ''")


def manifest_texts(words: DataFrame) -> DataFrame:
    """Words (image_id, id, text, x, y, height) of each image in reading order: by line (y over the word's height, to the nearest), then y, x and id."""
    height = F.when(F.coalesce("height", F.lit(0.0)) == 0, 1.0).otherwise(F.greatest(F.col("height"), F.lit(1.0)))
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    place = F.struct(F.when(known, F.bround(F.col("y") / height).cast("long")).otherwise(F.lit(0).cast("long")).alias("line"), F.when(known, F.col("y")).otherwise(0.0).alias("y"), F.when(known, F.col("x")).otherwise(0.0).alias("x"), F.col("id"), F.trim("text").alias("text"))
    some = words.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return some.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda w: w["text"]), " ").alias("text"))
