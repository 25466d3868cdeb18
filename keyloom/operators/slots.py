"""Slots of keyword rows: inference from a keyword and its product, and gaps against a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.keywords import UNIT_ONLY
from keyloom.functions.tables import spread
from keyloom.operators.rows import by_platform

PRICE_BAND = r"(?:^|[^\p{L}\p{N}_])[0-9]+\s*(?:원|만원|천원|달러|usd|유로)대(?:[^\p{L}\p{N}_]|$)"


def _holds(keyword: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(keyword, F.lower(t)))


def _none() -> Column:
    return F.array().cast("array<string>")


def slot_type(aliases: Column | None = None, brand: Column | None = None, types: Column | None = None, attributes: Column | None = None, audience: Column | None = None, events: Column | None = None, name: Column | None = None) -> Column:
    """Slot of a row (columns category, keyword) given the product's terms; absent terms match nothing."""
    kw = F.trim(F.regexp_replace("keyword", r"\s+", " "))
    low, cat = F.lower(kw), F.col("category")
    aliases, types, attributes, audience, events = (_none() if x is None else x for x in (aliases, types, attributes, audience, events))
    brand = F.coalesce(F.lit("") if brand is None else brand, F.lit(""))
    alias = F.array_contains(aliases, kw)
    suffix = None if name is None else F.trim(F.substring(kw, F.length(name) + 1, F.length(kw)))
    model = F.lit(False) if name is None else F.coalesce(kw.startswith(F.concat(name, F.lit(" "))) & F.lower(suffix).rlike(r"(?U)^\d{1,2}(?:세대|gen)?$"), F.lit(False))
    out = (
        F.when(cat == "brand", F.when(alias, "navigational_alias").when((brand != "") & F.contains(low, F.lower(brand)) & _holds(low, types), "brand_with_type").otherwise("product_name"))
        .when(cat == "feature_attribute", F.when(low.rlike(UNIT_ONLY), "spec").when(_holds(low, attributes), "core_attribute").otherwise("spec"))
        .when(cat == "purchase_intent", F.when(alias | model, "navigational_alias").otherwise("brand_with_type"))
        .when(cat == "long_tail", F.when(_holds(low, audience), "audience_phrase").otherwise("use_case_phrase"))
        .when(cat == "benefit_price", F.when(low.rlike(PRICE_BAND), "price_band").otherwise("product_price"))
        .when(cat == "season_event", F.when(_holds(low, events), "grounded_event").otherwise("seasonal_context"))
    )
    return F.coalesce(out, default_slot(cat))


def default_slot(category: Column) -> Column:
    out = F.lit("surface")
    for c, s in dims.DEFAULT_SLOTS.items():
        out = F.when(category == c, s).otherwise(out)
    return out


def slot_gaps(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Missing rows of each (url, category, slot_type) of a plan (category, slot_type, target) on both platforms, and the larger of the two."""
    counts = by_platform(rows).groupBy("url", "category", "slot_type").agg(F.count_if(F.col("platform") == "naver_sa").alias("n"), F.count_if(F.col("platform") == "google_sa").alias("g"))
    full = rows.select("url").distinct().crossJoin(F.broadcast(plan)).join(spread(counts), ["url", "category", "slot_type"], "left")
    gap = lambda c: F.greatest(F.lit(0), F.col("target") - F.coalesce(c, F.lit(0))).cast("long")
    out = full.select("url", "category", "slot_type", gap("n").alias("naver_gap"), gap("g").alias("google_gap"))
    return out.withColumn("gap", F.greatest("naver_gap", "google_gap")).where("gap > 0")


def gap_totals(gaps: DataFrame) -> DataFrame:
    """Gaps summed over platforms per category, and their total (category null), by one rollup."""
    return gaps.rollup("url", "category").agg(F.sum(F.col("naver_gap") + F.col("google_gap")).alias("missing")).where("url is not null")
