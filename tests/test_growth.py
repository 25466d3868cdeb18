"""Steps that once held up all else at size: one task, one worker's memory, or Python for every event."""

import random
import re
from pathlib import Path

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from keyloom.functions import structured
from keyloom.operators.jobs import DONE
from keyloom.sources import artifacts
from keyloom.streaming import jobs as closing
from tests.conftest import SF


def test_jobs_of_a_table_close_by_the_same_rules(spark):
    """Against a loop over the events; repeats, late registrations, unregistered tasks, equal times, nulls and unknown statuses included."""
    rng = random.Random(3)
    states = ["RECEIVED", "RECEIVED", "COMPLETED", "COMPLETED_CACHED", "FAILED_COLLECTION", "FAILED", "OTHER", None]
    rows = [(rng.choice("abcdefghijklmn") + str(i % 9), rng.choice(["1", "2", None, "3"]), rng.choice(states), rng.choice([1, 2, None]), rng.choice([1, 2, 3, 3, None])) for i in range(1500)]
    rows += [(None, "1", "RECEIVED", 1, 1), ("z", "1", "RECEIVED", 1, 5), ("z", "1", "COMPLETED", None, 4)]
    want = set()
    for job in {r[0] for r in rows if r[0]}:
        known, ended, stated, last = set(), {}, 0, 0
        for _, task, status, n, at in (r for r in rows if r[0] == job):
            if task is None or at is None or not (status == "RECEIVED" or status in DONE or (status or "").startswith("FAILED")):
                continue
            last = max(last, at)
            if status == "RECEIVED":
                known.add(task)
                stated = max(stated, n or 0)
            else:
                ended[task] = max(ended.get(task, (0, "")), (at, status))
        done = [s for t, (_, s) in ended.items() if t in known]
        if known and len(known) >= stated and len(done) == len(known):
            ok = sum(s in DONE for s in done)
            status = "PARTIAL_COMPLETED" if 0 < ok < len(done) else "COMPLETED" if ok else "FAILED"
            want.add((job, len(known), done.count("COMPLETED_CACHED"), ok, len(done) - ok, status, last))
    events = spark.createDataFrame(rows, "job_id string, task_id string, status string, submitted long, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    out = closing.finished(events)
    got = {tuple(r) for r in out.withColumn("finished_at", F.unix_seconds("finished_at")).collect()}
    assert got == want and len(want) > 5
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_items_are_written_by_all_cores(spark, tmp_path):
    row = spark.range(60).repartition(1).select((F.col("id") % 3).cast("string").alias("job_id"), F.col("id").cast("string").alias("url_task_id"), F.lit("u").alias("raw_url"), F.lit("p").alias("page_class"), F.lit("COMPLETED").alias("status"), F.lit(None).cast("string").alias("failure_code"), F.array().cast(f"array<{artifacts.ROW}>").alias("rows"))
    artifacts.write_items(row, str(tmp_path))
    files = [p.name for p in Path(tmp_path, "per_url").rglob("*.json")]
    assert len(files) == 60 and len({re.match(r"part-(\d+)", f)[1] for f in files}) > 4


@pytest.mark.parametrize("name", ["H04_image_candidates"])
def test_pages_are_dealt(spark, name):
    from keyloom.plans import more

    assert more._image_pages(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert entry.queries()[name](spark, SF).count() > 0


def test_bodies_reach_the_worker_in_small_batches():
    from pyspark.util import PythonEvalType

    assert structured.decode_body.evalType == PythonEvalType.SQL_BATCHED_UDF
