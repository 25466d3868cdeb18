"""Product facts: deduplication, completeness and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom import dims


def distinct_facts(facts: DataFrame) -> DataFrame:
    """First fact of each (type, value) without regard to case, numbered in order of arrival (columns url, ord, type, value)."""
    some = facts.where((F.trim(F.coalesce("type", F.lit(""))) != "") & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    by_key = Window.partitionBy("url", F.lower(F.trim("type")), F.lower(F.trim("value"))).orderBy("ord")
    first = some.withColumn("turn", F.row_number().over(by_key)).where("turn = 1").drop("turn")
    number = F.row_number().over(Window.partitionBy("url").orderBy("ord"))
    return first.withColumn("fact_id", F.concat(F.lit("f"), F.lpad(number.cast("string"), 3, "0")))


def fact_union(*sources: DataFrame) -> DataFrame:
    """Facts of several sources in order of priority: those of a type that a former source has are left out."""
    out = None
    for rank, source in enumerate(sources):
        tagged = source.withColumn("rank", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged)
    best = F.min("rank").over(Window.partitionBy("url", "type"))
    return out.withColumn("best", best).where("rank = best").drop("best")


def thin_packs(facts: DataFrame, page_class: Column) -> DataFrame:
    """Per url: whether a commerce page lacks a base fact or has fewer than two kinds of rich facts."""
    base, rich = F.col("type").isin(*dims.BASE_FACTS), F.col("type").isin(*dims.RICH_FACTS)
    agg = facts.withColumn("cls", page_class).groupBy("url").agg(F.first("cls").alias("cls"), F.count_distinct(F.when(base, F.col("type"))).alias("base"), F.count_distinct(F.when(rich, F.col("type"))).alias("rich"))
    thin = F.col("cls").isin(*dims.COMMERCE_CLASSES) & ((F.col("base") < len(dims.BASE_FACTS)) | (F.col("rich") < 2))
    return agg.select("url", "base", "rich", thin.alias("thin"))


def sanitized_price(raw: Column) -> Column:
    """Digits of a price; null unless four to six."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits).between(4, 6), digits)


def measurements(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[^\p{L}\p{N}_])([0-9]+\s?(?:ml|gb|tb|kg|mah|hz|mm|cm|inch|g|w))(?:$|[^\p{L}\p{N}_])"), F.lit(1))
