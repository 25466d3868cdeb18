"""Debug projections, drop reports and the comparison of text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.arrays import rows_of
from keyloom.functions.tables import spread

INTENT_FIELDS = ("intent_id", "category", "slot_type", "keyword", "reason", "evidence_tier", "quality_score")
ROW_FIELDS = ("category", "slot_type", "keyword", "naver_match", "google_match", "reason", "evidence_tier", "quality_score")
FLAGS = {"candidate": 2, "keep_testing": 1, "reject": 0}


def as_json(fields: tuple[str, ...]) -> Column:
    """The fields as JSON, those without a value as null."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def policy_drops(rows: DataFrame, intents: DataFrame) -> DataFrame:
    """One line for each hard issue of a dropped row, with the slot of the intent that it came from (the first of its category and keyword)."""
    first = intents.groupBy("url", "category", "keyword").agg(F.min_by("slot_type", "ord").alias("intent_slot"))
    lost = rows_of(rows.where(F.size("hard_issues") > 0), F.col("hard_issues"), "url", "category", "keyword", item="issue")
    out = lost.join(spread(first), ["url", "category", "keyword"], "left")
    code = F.when(F.col("issue") == "low_information", "dedup_low_quality").otherwise(F.col("issue"))
    return out.select("url", "keyword", "category", F.coalesce("intent_slot", F.lit("")).alias("slot_type"), F.lit("policy_filter").alias("drop_stage"), code.alias("drop_reason_code"), F.col("issue").alias("drop_reason_detail"))


def dedup_drops(answers: DataFrame, intents: DataFrame) -> DataFrame:
    """One line for each candidate that a deduplication answer dropped (url, kind duplicate or low_quality, keyword, category, quality_score, reason)."""
    first = intents.groupBy("url", "category", "keyword").agg(F.min_by("slot_type", "ord").alias("slot"), F.min("ord").alias("at"))
    named = first.withColumnRenamed("category", "own")
    tagged = answers.withColumn("n", F.monotonically_increasing_id())
    found = tagged.join(spread(named), ["url", "keyword"], "left").withColumn("turn", F.row_number().over(Window.partitionBy("n").orderBy(F.coalesce(F.col("own") == F.col("category"), F.lit(False)).desc(), "at"))).where("turn = 1")
    duplicate = F.col("kind") == "duplicate"
    code = F.when(duplicate, "semantic_duplicate").when(F.col("quality_score") == "low", "low_quality").otherwise("dedup_low_quality")
    detail = F.coalesce(F.nullif("reason", F.lit("")), F.when(duplicate, "semantic duplicate").otherwise("low quality"))
    return found.select("url", "keyword", F.coalesce("own", "category", F.lit("")).alias("category"), F.coalesce("slot", F.lit("")).alias("slot_type"), F.lit("dedup_quality").alias("drop_stage"), code.alias("drop_reason_code"), detail.alias("drop_reason_detail"))


def recommendation(rows: DataFrame, baseline: str = "raw_html") -> DataFrame:
    """Rows of cases and text sources (case_id, candidate_source, page_class, supported, chars, blocks, facts) beside their baseline: deltas, regressions, and whether the source is worth taking."""
    base = rows.where(F.col("candidate_source") == baseline).select("case_id", *[F.col(c).alias("b_" + c) for c in ("page_class", "supported", "chars", "blocks", "facts")])
    out = rows.join(spread(base), "case_id")
    changed = (F.col("page_class") != F.col("b_page_class")) | (F.col("supported") != F.col("b_supported"))
    known = lambda c: F.col(c).isin(*dims.SUPPORTED_CLASSES)
    fewer = (F.col("blocks") > 0) & (F.col("b_blocks") > 0) & (F.col("blocks") * 2 < F.col("b_blocks"))
    flag = F.when(changed | (~known("page_class") & known("b_page_class")) | fewer, "reject").when((F.col("candidate_source") == "fit_markdown") & (F.col("facts") <= F.col("b_facts")), "keep_testing").when(F.col("chars") > F.col("b_chars"), "candidate").otherwise("keep_testing")
    stages = F.array_compact(F.array(F.when(changed, "classification"), F.when(F.col("facts") != F.col("b_facts"), "evidence")))
    deltas = [(F.col(c) - F.col("b_" + c)).alias(c + "_delta") for c in ("chars", "blocks", "facts")]
    return out.select(*rows.columns, *deltas, stages.alias("regressions"), flag.alias("flag"))


def best_sources(recommended: DataFrame) -> DataFrame:
    """The best source of each case: by flag, then by characters, then the first by name."""
    rank = F.lit(0)
    for name, value in FLAGS.items():
        rank = F.when(F.col("flag") == name, value).otherwise(rank)
    turn = F.row_number().over(Window.partitionBy("case_id").orderBy(rank.desc(), F.desc("chars"), "candidate_source"))
    return recommended.withColumn("turn", turn).where("turn = 1").drop("turn")


def regression_counts(recommended: DataFrame) -> DataFrame:
    return rows_of(recommended, F.col("regressions"), "case_id", item="stage").groupBy("stage").agg(F.count("*").alias("n"))
