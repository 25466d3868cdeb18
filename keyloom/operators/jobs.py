"""Jobs, tasks and the result cache as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE = ("COMPLETED", "COMPLETED_CACHED")


def job_status(ok: Column, failed: Column) -> Column:
    return F.when((ok > 0) & (failed > 0), "PARTIAL_COMPLETED").when(ok > 0, "COMPLETED").otherwise("FAILED")


def status_counts(tasks: DataFrame) -> DataFrame:
    """Per job: submitted, cached, succeeded, failed, open tasks, status (columns job_id, task_id, status)."""
    agg = tasks.groupBy("job_id").agg(
        F.count("*").alias("submitted"),
        F.count_if(F.col("status") == "COMPLETED_CACHED").alias("cached"),
        F.count_if(F.col("status").isin(*DONE)).alias("succeeded"),
        F.count_if(F.col("status").startswith("FAILED")).alias("failed"),
        F.count_if(F.col("status") == "RECEIVED").alias("open"),
    )
    return agg.withColumn("status", F.when(F.col("open") > 0, "PROCESSING").otherwise(job_status(F.col("succeeded"), F.col("failed"))))


def terminal_jobs(tasks: DataFrame) -> DataFrame:
    """Jobs without an open task: one summary each."""
    return status_counts(tasks).where("open = 0").drop("open")


def latest(items: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Whole-item upsert: the last version of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return items.withColumn("turn", turn).where("turn = 1").drop("turn")


def cache_routes(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """hit, partial or miss of each task against cached components (canonical_url, platform): two left joins on one key."""
    side = lambda p: cache.where(F.col("platform") == p).select("canonical_url", F.lit(True).alias(p)).distinct()
    out = tasks.join(side("naver_sa"), "canonical_url", "left").join(side("google_sa"), "canonical_url", "left")
    n, g = F.col("naver_sa").isNotNull(), F.col("google_sa").isNotNull()
    route = F.when(n & g, "hit").when(n | g, "partial").otherwise("miss")
    need = F.when(n & g, "").when(n, "google_sa").when(g, "naver_sa").otherwise("both")
    return out.select("task_id", "canonical_url", route.alias("route"), need.alias("generate"))


def merged_components(naver: DataFrame, google: DataFrame) -> DataFrame:
    """Rows of both cached components, one after the other, without deduplication."""
    return naver.withColumn("component", F.lit("naver_sa")).unionByName(google.withColumn("component", F.lit("google_sa")))


def stale_entries(cache: DataFrame, dead: DataFrame, now: Column, min_days: int = 7) -> DataFrame:
    """Entries of ``min_days`` or more whose url is gone (a semi join on the url)."""
    return cache.where(F.col("modified") <= now - F.expr(f"interval {min_days} days")).join(dead.select("url").distinct(), "url", "left_semi")


def notifications(terminal: DataFrame) -> DataFrame:
    """One outbox record per finished job."""
    counts = F.struct(F.col("submitted"), F.col("succeeded"), F.col("failed"))
    return terminal.select("job_id", "status", F.to_json(counts).alias("counts"))
