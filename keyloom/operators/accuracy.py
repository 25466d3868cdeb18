"""Accuracy of recognised text, golden expectations and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.tables import spread


def normal_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]+", " "))


def character_errors(pairs: DataFrame) -> DataFrame:
    """Edit distance and length of (id, reference, prediction) after normalisation: CER is their ratio."""
    r, p = normal_text(F.col("reference")), normal_text(F.col("prediction"))
    return pairs.select("id", F.levenshtein(r, p).cast("long").alias("errors"), F.length(r).cast("long").alias("length"))


def word_overlap(pairs: DataFrame) -> DataFrame:
    """Multiset matches of words with both totals, per id: precision, recall and F1 follow. One shuffle on (id, word)."""
    side = lambda c, n: pairs.select("id", F.explode(F.filter(F.split(normal_text(F.col(c)), " "), lambda w: w != "")).alias("w")).groupBy("id", "w").agg(F.count("*").alias(n))
    both = side("reference", "r").join(spread(side("prediction", "p")), ["id", "w"], "full")
    zero = F.lit(0)
    return both.groupBy("id").agg(F.sum(F.least(F.coalesce("r", zero), F.coalesce("p", zero))).alias("matched"), F.sum(F.coalesce("r", zero)).alias("reference_words"), F.sum(F.coalesce("p", zero)).alias("predicted_words"))


def golden_diff(rows: DataFrame, must_keep: DataFrame, must_not: DataFrame) -> DataFrame:
    """Expected keywords that are absent (anti join) and forbidden ones that are present (semi join); columns url, keyword."""
    key = lambda d: d.select("url", F.trim(F.regexp_replace(F.lower("keyword"), r"[|/_\s]+", " ")).alias("keyword")).distinct()
    seen = key(rows)
    missing = key(must_keep).join(spread(seen), ["url", "keyword"], "left_anti").withColumn("finding", F.lit("missing"))
    emitted = key(must_not).join(spread(seen), ["url", "keyword"], "left_semi").withColumn("finding", F.lit("forbidden"))
    return missing.unionByName(emitted)


def merged_lines(blocks: DataFrame, most: int = 3, chars: int = 96, short: int = 32) -> DataFrame:
    """Greedy merging of consecutive short blocks (columns image, tile, ord, text): a fold over each tile's ordered blocks."""
    items = F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))))
    start = F.lit(None).cast("array<struct<text:string,n:int,open:boolean>>")
    fold = F.aggregate(
        items,
        F.coalesce(start, F.array().cast("array<struct<text:string,n:int,open:boolean>>")),
        lambda acc, x: F.when(
            (F.size(acc) > 0)
            & F.coalesce(F.try_element_at(acc, F.lit(-1))["open"], F.lit(False))
            & (F.coalesce(F.try_element_at(acc, F.lit(-1))["n"], F.lit(0)) < most)
            & (F.length(x["text"]) <= short)
            & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1))["text"], F.lit(""))) + F.length(x["text"]) <= chars),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.concat(F.try_element_at(acc, F.lit(-1))["text"], F.lit(" "), x["text"]).alias("text"), (F.try_element_at(acc, F.lit(-1))["n"] + 1).alias("n"), F.lit(True).alias("open"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["text"].alias("text"), F.lit(1).alias("n"), (F.length(x["text"]) <= short).alias("open"))))),
    )
    grouped = blocks.groupBy("image", "tile").agg(fold.alias("g"))
    return grouped.select("image", "tile", F.posexplode("g").alias("group_no", "x")).select("image", "tile", "group_no", "x.text", F.col("x.n").alias("blocks"))
