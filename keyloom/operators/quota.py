"""Apportionment of keyword targets to categories and slots, as windows over seats rather than loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.tables import spread


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(dims.CATEGORY_TARGETS.items())], "pos int, category string, target int")


def largest_remainder(targets: DataFrame, dim: DataFrame) -> DataFrame:
    """Plan of each total (column ``total``): one seat each, the rest by share, leftovers by (fraction, target) descending.

    Shares are compared as integers: fraction of target * remaining / sum of targets.
    """
    whole = sum(dims.CATEGORY_TARGETS.values())
    rest = F.greatest(F.lit(0), F.col("total") - len(dims.CATEGORY_TARGETS))
    x = targets.crossJoin(dim).withColumn("scaled", F.col("target") * rest)
    x = x.withColumn("floor", F.floor(F.col("scaled") / whole)).withColumn("fraction", F.col("scaled") % whole)
    by_total = Window.partitionBy("total")
    place = F.row_number().over(by_total.orderBy(F.desc("fraction"), F.desc("target"), "pos"))
    left = rest - F.sum("floor").over(by_total)
    plan = F.when(F.col("total") <= 0, 0).when(F.col("total") == whole, F.col("target")).otherwise(1 + F.col("floor") + F.when(place <= left, 1).otherwise(0))
    return x.select("total", "category", plan.cast("long").alias("seats"))


def divisor_plan(demand: DataFrame) -> DataFrame:
    """Seats of each key (columns key, total, pos, category, target, strength, weight, available): one each, then the largest weight / (n + 0.5) first.

    The k-th extra seat of a category has the priority weight / (k + 0.5), k from 1, so the greedy loop
    is a top-k over all seats; ties go to the one with more seats to spare, then by target, then by pos.
    With fewer seats than categories, the strongest get one each (ties by target, then by name).
    """
    active = demand.where("available > 0")
    lead = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("strength"), F.desc("target"), "category"))
    active = active.withColumn("lead", lead).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    extra = active.where("total > n").withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("available") - 1)))).where("k < available")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.col("weight") / (F.col("k") + 0.5)), F.desc(F.col("available") - F.col("k")), F.desc("target"), "pos", "k"))
    won = extra.withColumn("place", place).where("place <= total - n").groupBy("key", "category").agg(F.count("*").alias("more"))
    base = active.withColumn("one", F.when((F.col("total") > 0) & ((F.col("total") >= F.col("n")) | (F.col("lead") <= F.col("total"))), 1).otherwise(0))
    return base.join(spread(won), ["key", "category"], "left").select("key", "category", (F.col("one") + F.coalesce("more", F.lit(0))).cast("long").alias("seats"))


def slot_split(slots: DataFrame) -> DataFrame:
    """Targets of slots (columns key, total, slot, seeds, is_primary): the primary slot one, the rest by seeds, leftovers to the largest."""
    w = F.greatest(F.lit(1), F.col("seeds"))
    x = slots.withColumn("w", w).withColumn("sum", F.sum(w).over(Window.partitionBy("key")))
    rest = F.greatest(F.lit(0), F.col("total") - 1)
    x = x.withColumn("floor", F.floor(rest * F.col("w") / F.col("sum")))
    left = rest - F.sum("floor").over(Window.partitionBy("key"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("w"), F.desc("is_primary"), "slot"))
    seats = F.when(F.col("total") <= 0, 0).otherwise(F.when(F.col("is_primary"), 1).otherwise(0) + F.col("floor") + F.when(place <= left, 1).otherwise(0))
    return x.select("key", "slot", seats.cast("long").alias("seats"))


def category_gaps(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """Missing rows of (key, category) against a plan (category, seats); counts: key, category, n. Keys and plan meet by a cross with the small plan."""
    keys = counts.select("key").distinct()
    full = keys.crossJoin(F.broadcast(plan)).join(spread(counts), ["key", "category"], "left")
    return full.select("key", "category", F.greatest(F.lit(0), F.col("seats") - F.coalesce("n", F.lit(0))).cast("long").alias("gap"))
