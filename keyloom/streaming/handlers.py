"""Requests of the service over the tables of its queues: a job is submitted, and asked for."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import api
from keyloom.operators.jobs import DONE
from keyloom.streaming import stages
from keyloom.streaming.jobs import CACHED, RECEIVED


def status_payloads(spark: SparkSession, root: str, job_ids: list[str]) -> DataFrame:
    """One row for each known job of ``job_ids``: job_id, mode, status, counts, its tasks in order, its target, and the folder of its files (null before the end)."""
    own = lambda name: stages.table(spark, root, name).where(F.col("job_id").isin(job_ids))
    # a bucket of results holds the jobs of a request and few others
    results = stages.table(spark, root, "results").where(F.col("bucket").isin([r.b for r in spark.createDataFrame([(j,) for j in job_ids], "job_id string").select(stages._bucket(F.col("job_id")).alias("b")).distinct().collect()]))
    made = results.where(F.col("job_id").isin(job_ids)).dropDuplicates(["job_id", "url_task_id"]).select("job_id", F.col("url_task_id").alias("task_id"), "status", "page_class", "failure_code", "failure_detail", "hints", "cache_hit")
    tasks = own("tasks").dropDuplicates(["job_id", "task_id"]).join(made, ["job_id", "task_id"], "left")
    task = F.struct(F.col("task_id").alias("url_task_id"), "raw_url", F.coalesce("status", F.lit(RECEIVED)).alias("status"), "page_class", "failure_code", "failure_detail", F.coalesce("hints", F.array().cast("array<string>")).alias("failure_reason_hints"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"))
    listed = tasks.groupBy("job_id").agg(F.array_sort(F.collect_list(task)).alias("url_tasks"), F.count_if(F.col("status") == CACHED).alias("cached"), F.count_if(F.col("generate") != "").alias("misses"))
    finished = own("finished")
    finished = finished if "batch" in finished.columns else finished.withColumn("batch", F.lit(None).cast("string"))
    ended = finished.dropDuplicates(["job_id"]).select("job_id", F.col("status").alias("ended"), "succeeded", "failed", F.concat(F.lit(f"{root}/artifacts/batch="), "batch").alias("folder"))
    sent = own("outbox").select("job_id", F.lit(True).alias("sent")).distinct()
    out = own("jobs").dropDuplicates(["job_id"]).join(listed, "job_id").join(ended, "job_id", "left").join(sent, "job_id", "left")
    status = F.coalesce("ended", F.when(F.col("misses") > 0, "PROCESSING").otherwise(RECEIVED))
    zero = F.lit(0).cast("long")
    return out.select("job_id", "mode", status.alias("status"), "submitted", "cached", F.coalesce("succeeded", zero).alias("succeeded"), F.coalesce("failed", zero).alias("failed"), "url_tasks", "target", F.coalesce("sent", F.lit(False)).alias("sent"), "folder")


def _response(code: int, payload: dict) -> dict:
    return {"statusCode": code, "headers": {"Content-Type": "application/json"}, "body": json.dumps(payload, ensure_ascii=False, sort_keys=True)}


def _target(raw: dict | None) -> str | None:
    """A checked notification target in the form in which notices carry it."""
    if raw is None:
        return None
    kind = "email" if raw.get("email") else "webhook"
    return json.dumps({"target_type": kind, "value": str(raw[kind])}, ensure_ascii=False)


def submit_job(spark: SparkSession, root: str, event: dict) -> dict:
    """202 and the new job's id, or 400 or 422 and what is wrong. The body is an object or its JSON."""
    body = event.get("body")
    try:
        body = {} if body is None else body if isinstance(body, dict) else json.loads(body)
    except ValueError:
        return _response(400, {"error": "body must be JSON"})
    if not isinstance(body, dict):
        return _response(400, {"error": "body must be an object"})
    code, error = api.check_request(body)
    if error:
        return _response(code, {"error": error})
    job, mode = f"job_{uuid.uuid4().hex[:16]}", body.get("requested_platform_mode", "both")
    asked = spark.createDataFrame([(job, [str(u) for u in body["urls"]], mode, _target(body.get("notification_target")))], "job_id string, urls array<string>, mode string, target string")
    stages.submit(asked.withColumn("ts", F.current_timestamp()), root, job)
    state = status_payloads(spark, root, [job]).first()
    return _response(code, {"job_id": job, "status": RECEIVED, "requested_platform_mode": mode, "submitted_count": state.submitted, "cached_count": state.cached, "status_url": f"/jobs/{job}", "result_manifest_url": f"/jobs/{job}/results/per_url_manifest"})


def get_job(spark: SparkSession, root: str, event: dict) -> dict:
    """200 and the state of a job, 400 without an id, 404 if there is no such job."""
    job = str((event.get("pathParameters") or {}).get("job_id") or "").strip()
    if not job:
        return _response(400, {"error": "job_id is required"})
    r = status_payloads(spark, root, [job]).first()
    if r is None:
        return _response(404, {"error": "job not found"})
    at = lambda name: f"{r.folder}/{name}" if r.folder else None
    files = {"result_manifest_url": at("manifest"), "combined_json_url": at(f"combined/job_id={job}"), "combined_csv_url": at(f"csv/job_id={job}"), "failures_json_url": at(f"failures/job_id={job}")}
    if not any(t.status in DONE for t in r.url_tasks):
        files |= {"combined_json_url": None, "combined_csv_url": None}
    if not r.failed:
        files["failures_json_url"] = None
    target = None if r.target is None else json.loads(r.target) | {"sent": r.sent}
    counts = {"submitted": r.submitted, "cached": r.cached, "succeeded": r.succeeded, "failed": r.failed}
    return _response(200, {"job_id": job, "status": r.status, "requested_platform_mode": r.mode, "counts": counts, "artifacts": files, "url_tasks": [t.asDict() for t in r.url_tasks], "notification": target})


def route(spark: SparkSession, root: str, event: dict) -> dict:
    """The response to a request: ``POST /jobs``, ``GET /jobs/{job_id}``; 404 for other paths, 405 for other methods."""
    method, parts = str(event.get("httpMethod") or "GET").upper(), [p for p in str(event.get("path") or "").split("/") if p]
    if parts[:1] != ["jobs"] or len(parts) > 2:
        return _response(404, {"error": "no such path"})
    if len(parts) == 1:
        return submit_job(spark, root, event) if method == "POST" else _response(405, {"error": "method not allowed"})
    return get_job(spark, root, event | {"pathParameters": {"job_id": parts[1]}}) if method == "GET" else _response(405, {"error": "method not allowed"})
