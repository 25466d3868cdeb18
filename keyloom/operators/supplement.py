"""What keyword rows still lack against a plan, and rounds of asking for it until nothing is lacking or nothing more comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import keywords as K
from keyloom.functions.tables import spread
from keyloom.operators import slots
from keyloom.operators.intents import MODES
from keyloom.operators.rows import by_platform
from keyloom.scratch import drop, written

#: From a round's number, its targets (url, category, slot_type, target) and the rows so far to rows that were not there.
Ask = Callable[[int, DataFrame, DataFrame], DataFrame]
Clean = Callable[[DataFrame], DataFrame]


def _on(rows: DataFrame, mode: str) -> DataFrame:
    return by_platform(rows).where(F.col("platform").isin(*MODES[mode]))


def slot_gaps(rows: DataFrame, plan: DataFrame, mode: str = "both") -> DataFrame:
    """Missing rows (url, category, slot_type, gap) of a plan per product (url, category, slot_type, target): the larger gap of the wanted platforms. A row without a slot takes its category's."""
    slot = F.coalesce(F.nullif(F.trim("slot_type"), F.lit("")), slots.default_slot(F.col("category")))
    counts = _on(rows, mode).groupBy("url", "category", slot.alias("slot_type")).pivot("platform", list(MODES[mode])).count()
    least = F.least(*[F.coalesce(p, F.lit(0)) for p in MODES[mode]]) if len(MODES[mode]) > 1 else F.coalesce(MODES[mode][0], F.lit(0))
    gap = F.col("target") - F.coalesce(least, F.lit(0))
    return plan.join(spread(counts), ["url", "category", "slot_type"], "left").withColumn("gap", gap.cast("long")).where("gap > 0").select("url", "category", "slot_type", "gap")


def category_gaps(products: DataFrame, rows: DataFrame, mode: str = "both") -> DataFrame:
    """Categories (url, category) that a wanted platform of a product (url) has no row of, negative ones among them."""
    every = [*dims.CATEGORY_TARGETS, dims.NEGATIVE]
    wanted = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(p).alias("platform")) for c in every for p in MODES[mode]])
    asked = products.select("url").distinct().select("url", F.explode(wanted).alias("x")).select("url", "x.*")
    return asked.join(spread(_on(rows, mode).select("url", "category", "platform").distinct()), ["url", "category", "platform"], "left_anti").select("url", "category").distinct()


def shortfalls(products: DataFrame, rows: DataFrame, most: int, mode: str = "both") -> DataFrame:
    """By how many positive rows (url, shortfall) a product's poorest wanted platform is below ``most``."""
    counts = _on(rows, mode).where(F.col("category") != dims.NEGATIVE).groupBy("url").agg(*[F.count_if(F.col("platform") == p).alias(p) for p in MODES[mode]])
    short = [F.lit(most) - F.coalesce(p, F.lit(0)) for p in MODES[mode]]
    worst = F.greatest(F.lit(0), *short)
    return products.select("url").distinct().join(spread(counts), "url", "left").select("url", worst.cast("long").alias("shortfall"))


def targets(products: DataFrame, rows: DataFrame, plan: DataFrame, most: int = 100, mode: str = "both") -> DataFrame:
    """How many rows to ask for (url, category, slot_type, target), and their sum by product (``total``).

    ``plan``: url, place, category, slot_type, target, required. A category without rows asks for one, in its required slot, else its first, else its
    usual one. An open slot of any other category asks for one. What that leaves of the shortfall is
    spread over the required positive slots by their targets, at least one each; what is then too much comes off again from the last slot
    to the first, each keeping one: a running sum, capped by the surplus.
    """
    key = ["url", "category", "slot_type"]
    lacking = category_gaps(products, rows, mode)
    chosen = plan.groupBy("url", "category").agg(F.min_by("slot_type", F.struct(~F.col("required"), "place")).alias("chosen"))
    first = lacking.join(spread(chosen), ["url", "category"], "left").select("url", "category", F.coalesce("chosen", slots.default_slot(F.col("category"))).alias("slot_type"), F.lit(1).cast("long").alias("n"))
    positive = lacking.where(F.col("category") != dims.NEGATIVE)
    open_ = slot_gaps(rows, plan, mode).join(spread(positive), ["url", "category"], "left_anti").select(*key, F.lit(1).cast("long").alias("n"))
    asked = first.unionByName(open_).groupBy(*key).agg(F.max("n").alias("n"))
    some = asked.where(F.col("category") != dims.NEGATIVE).groupBy("url").agg(F.sum("n").alias("named"))
    left = shortfalls(products, rows, most, mode).join(spread(some), "url", "left").select("url", F.greatest(F.lit(0), F.col("shortfall") - F.coalesce("named", F.lit(0))).alias("left")).where("left > 0")
    weighted = plan.where(F.col("required") & (F.col("category") != dims.NEGATIVE)).join(spread(left), "url").join(spread(asked), key, "left")
    product = Window.partitionBy("url")
    weight = F.greatest(F.lit(1), F.col("target"))
    weighted = weighted.withColumn("extra", F.greatest(F.lit(1), F.floor(F.col("left") * weight / F.sum(weight).over(product))))
    weighted = weighted.withColumns({"now": F.coalesce("n", F.lit(0)) + F.col("extra"), "surplus": F.greatest(F.lit(0), F.sum("extra").over(product) - F.col("left"))})
    later = product.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.least(F.col("now") - 1, F.greatest(F.lit(0), F.col("surplus") - F.coalesce(F.sum(F.col("now") - 1).over(later), F.lit(0))))
    due = weighted.select(*key, (F.col("now") - taken).cast("long").alias("spread"))
    out = asked.join(spread(due), key, "full").select(*key, F.coalesce("spread", "n").alias("target"))
    return out.withColumn("total", F.sum("target").over(product))


def supplemented(products: DataFrame, rows: DataFrame, plan: DataFrame, ask: Ask, clean: Clean | None = None, most: int = 100, mode: str = "both", rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows with what ``ask`` adds in at most ``rounds`` rounds, and a report by product (url, rounds, missing, added, reason).

    A round plans from the rows there are, asks for all that is lacking, cleans what comes (``clean``) and keeps what no row of the product
    says yet (by category and signature of the keyword). Products that lack nothing are not asked for again; neither are those that a round brought nothing.
    The rows of every round are a table, so a later round reads them and computes nothing anew. ``reason``: closed, nothing new, or limit.
    """
    clean = clean or (lambda x: x)
    said = lambda df: df.withColumn("said_", K.semantic_signature(F.col("keyword")))
    names = rows.columns
    products = written(products.select("url").distinct())
    have, going = written(rows.withColumn("round", F.lit(0))), products
    last = products.select("url", F.lit(0).alias("rounds"))
    for number in range(1, rounds + 1):
        wanted = written(targets(going, have.join(spread(going), "url", "left_semi"), plan.join(spread(going), "url", "left_semi"), most, mode))
        if wanted.isEmpty():
            drop(wanted)
            break
        new = said(clean(ask(number, wanted.select("url", "category", "slot_type", "target"), have.select(*names)))).join(spread(wanted.select("url").distinct()), "url", "left_semi")
        first = F.row_number().over(Window.partitionBy("url", "category", "said_").orderBy("ord"))
        new = new.withColumn("turn_", first).where("turn_ = 1").join(spread(said(have).select("url", "category", "said_").distinct()), ["url", "category", "said_"], "left_anti")
        new = written(new.select(*names, F.lit(number).alias("round")))
        before, have = have, written(have.unionByName(new))
        asked = written(wanted.select("url").distinct())
        last = last.join(spread(asked.select("url", F.lit(number).alias("now_"))), "url", "left").select("url", F.coalesce("now_", "rounds").alias("rounds"))
        going = written(asked.join(spread(new), "url", "left_semi"))
        for table in (before, new, wanted):
            drop(table)
        if going.isEmpty():
            break
    missing = targets(products, have, plan, most, mode).groupBy("url").agg(F.sum("target").alias("missing"))
    added = have.where("round > 0").groupBy("url").agg(F.count("*").alias("added"), F.max("round").alias("best"))
    zero = F.lit(0).cast("long")
    report = last.join(spread(missing), "url", "left").join(spread(added), "url", "left").select("url", "rounds", F.coalesce("missing", zero).alias("missing"), F.coalesce("added", zero).alias("added"), F.coalesce("best", F.lit(0)).alias("best"))
    reason = F.when(F.col("missing") == 0, "closed").when(F.col("rounds") > F.col("best"), "nothing new").otherwise("limit")
    return have.select(*names), report.withColumn("reason", reason).drop("best")
