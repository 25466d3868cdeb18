"""Requests of the service: argument checks, job intake as relations, and injected model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from keyloom.functions import web
from keyloom.operators import jobs

MODES = ("naver_sa", "google_sa", "both")
MOST_URLS = 30


def check_request(body: dict) -> tuple[int, str | None]:
    """Status code and error of a job request: 202, 400 or 422."""
    urls = body.get("urls")
    if not isinstance(urls, list) or not urls:
        return 400, "urls must be a non-empty list"
    if len(urls) > MOST_URLS:
        return 422, f"urls must contain at most {MOST_URLS} entries"
    if body.get("requested_platform_mode", "both") not in MODES:
        return 422, "unsupported requested_platform_mode"
    target = body.get("notification_target")
    if target is not None and not isinstance(target, dict):
        return 400, "notification_target must be an object"
    if target is not None and bool(target.get("email")) == bool(target.get("webhook")):
        return 400, "notification_target must include exactly one of email or webhook"
    return 202, None


def submit(spark: SparkSession, job_id: str, body: dict, cache: DataFrame) -> DataFrame:
    """Tasks of a checked request with canonical url, cache keys and route; raises ValueError otherwise."""
    code, error = check_request(body)
    if error:
        raise ValueError(f"{code}: {error}")
    urls = spark.createDataFrame([(job_id, i, str(u)) for i, u in enumerate(body["urls"])], "job_id string, task_id long, raw_url string")
    tasks = urls.withColumn("canonical_url", web.canonical_url(F.col("raw_url")))
    for p in MODES[:2]:
        tasks = tasks.withColumn(f"{p}_key", web.cache_key(F.col("canonical_url"), p))
    return tasks.join(jobs.cache_routes(tasks.select("task_id", "canonical_url"), cache).drop("canonical_url"), "task_id")


def with_model(df: DataFrame, call: Callable[[list[dict]], list[str | None]], out_col: str = "answer") -> DataFrame:
    """Append the answers of an injected model (language model, recogniser, browser) to rows, a batch at a time, and the error of each call that failed.

    If a call for a batch fails, its rows are asked one by one, so only those that fail again have no answer.
    """
    schema = StructType([*df.schema.fields, StructField(out_col, StringType()), StructField(out_col + "_error", StringType())])

    def ask(rows: list[dict]) -> tuple[list[str | None], list[str | None]]:
        try:
            answers = list(call(rows))
            if len(answers) != len(rows):
                raise ValueError(f"{len(answers)} answers to {len(rows)} rows")
            return answers, [None] * len(rows)
        except Exception as error:  # noqa: BLE001 - an external service: the row stays, with the error
            if len(rows) == 1:
                return [None], [f"{type(error).__name__}: {error}"]
        parts = [ask([r]) for r in rows]
        return [a for p, _ in parts for a in p], [e for _, p in parts for e in p]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = ask(b.to_dict("records")) if len(b) else ([], [])
            yield b.assign(**{out_col: answers, out_col + "_error": errors})

    return df.mapInPandas(run, schema)


def first_model(models: list[str], call: Callable[[str, str], str]) -> Callable[[str], tuple[str, str]]:
    """A caller of the first model that answers: gives its name and answer, or raises the last error."""

    def ask(prompt: str) -> tuple[str, str]:
        error: Exception = ValueError("no model named")
        for m in models:
            try:
                return m, call(m, prompt)
            except Exception as e:  # noqa: BLE001 - the next model may answer
                error = e
        raise error

    return ask


def product_gate(classified: DataFrame, is_sales_page: Callable[[list[dict]], list[str | None]]) -> DataFrame:
    """Let a model overrule the page class (answers ``true`` or ``false``); blocked, waiting and support pages are not asked."""
    asked = ~F.col("page_class").isin("blocked_page", "waiting_page", "support_spec_page", "document_download_heavy_support_page")
    answered = with_model(classified.where(asked), is_sales_page, "sales").drop("sales_error").unionByName(classified.where(~asked).withColumn("sales", F.lit(None).cast("string")))
    return answered.withColumn("page_class", F.when(F.lower("sales") == "false", "non_product_page").otherwise(F.col("page_class"))).drop("sales")
