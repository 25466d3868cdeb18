"""Streams: jobs are closed once under redelivery, disorder, unknown tasks and restarts; the three queues run from files to files."""

import json
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyloom.streaming import jobs, stages


def events_of(folder, rows, name):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"job_id": j, "task_id": t, "status": s, "submitted": n, "ts": f"2024-01-01T00:00:{k:02d}"}) for j, t, s, n, k in rows))


def run(spark, folder, out, check, remember=jobs.REMEMBER, fail_at=None):
    """All batches there are, appended to ``out``; a batch may die after its state was written but before it is committed."""

    def write(df, number):
        if fail_at == number:
            raise RuntimeError("lost")
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = jobs.finished(jobs.read_events(spark, str(folder), per_trigger=1), remember)
    query = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        assert fail_at is not None
    return sorted((r.job_id, r.submitted, r.cached, r.succeeded, r.failed, r.status) for r in spark.read.schema(jobs.SUMMARY).parquet(str(out)).collect())


def test_a_job_is_closed_once(spark, tmp_path):
    q, out, check = tmp_path / "q", tmp_path / "out", tmp_path / "check"
    events_of(q, [("a", "1", "RECEIVED", 2, 0), ("a", "2", "COMPLETED", None, 5), ("b", "1", "RECEIVED", 1, 0)], 0)  # an end before its registration
    events_of(q, [("x", "1", "COMPLETED", None, 1), ("a", "9", "FAILED_COLLECTION", None, 1), ("b", "1", "COMPLETED_CACHED", None, 1)], 1)  # unknown job and task
    assert run(spark, q, out, check) == [("b", 1, 1, 1, 0, "COMPLETED")]
    events_of(q, [("a", "2", "RECEIVED", 2, 0), ("b", "1", "COMPLETED_CACHED", None, 1), ("b", "1", "RECEIVED", 1, 0)], 2)  # a late registration, redelivery
    assert run(spark, q, out, check, fail_at=2) == [("b", 1, 1, 1, 0, "COMPLETED")]
    events_of(q, [("a", "1", "FAILED_GENERATION", None, 8), ("a", "1", "COMPLETED", None, 7)], 3)  # the later status counts
    want = [("a", 2, 0, 1, 1, "PARTIAL_COMPLETED"), ("b", 1, 1, 1, 0, "COMPLETED")]
    assert run(spark, q, out, check) == want
    events_of(q, [("a", "1", "COMPLETED", None, 9), ("a", "1", "RECEIVED", 2, 0), ("c", None, "COMPLETED", None, 1), (None, "1", "COMPLETED", None, 1), ("c", "1", "PROCESSING", 1, 1)], 4)
    assert run(spark, q, out, check) == want


def test_timers_forget_closed_and_unknown_jobs(spark, tmp_path):
    q, out, check = tmp_path / "q", tmp_path / "out", tmp_path / "check"
    events_of(q, [("a", "1", "RECEIVED", 1, 0), ("a", "1", "COMPLETED", None, 1), ("x", "1", "COMPLETED", None, 1), ("o", "1", "RECEIVED", 1, 0)], 0)
    run(spark, q, out, check, remember=1)
    time.sleep(0.1)
    events_of(q, [("y", "1", "RECEIVED", 1, 0)], 1)
    run(spark, q, out, check, remember=1)
    left = spark.read.format("statestore").option("path", str(check)).option("stateVarName", "counts").load()
    assert {r[0] for r in left.select("key.*").collect()} == {"o", "y"}  # open jobs stay


def brute_summaries(rows):
    size, known, last = defaultdict(int), defaultdict(set), {}
    for j, t, s, n, k in rows:
        if s == "RECEIVED":
            size[j] = max(size[j], n)
            known[j].add(t)
        else:
            last[j, t] = max(last.get((j, t), (-1, "")), (k, s))
    out = []
    for j, tasks in known.items():
        ends = [last.get((j, t), (0, ""))[1] for t in tasks]
        if len(tasks) >= size[j] and all(ends):
            good = sum(e.startswith("COMPLETED") for e in ends)
            out.append((j, len(tasks), ends.count("COMPLETED_CACHED"), good, len(ends) - good, "COMPLETED" if good == len(ends) else "PARTIAL_COMPLETED" if good else "FAILED"))
    return sorted(out)


def test_closing_a_table_equals_brute_force(spark):
    r = random.Random(4)
    rows = []
    for j in range(40):
        n = r.randint(1, 6)
        for t in range(n):
            rows += [(f"j{j}", f"t{t}", "RECEIVED", n, 0)] * r.choice([0, 1, 1, 1, 2])
            rows += [(f"j{j}", f"t{t}", r.choice(["COMPLETED", "COMPLETED_CACHED", "FAILED_COLLECTION"]), None, r.randint(1, 9)) for _ in range(r.choice([0, 1, 1, 2]))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id string, task_id string, status string, submitted long, k int").withColumn("ts", F.timestamp_seconds("k"))
    got = sorted((x.job_id, x.submitted, x.cached, x.succeeded, x.failed, x.status) for x in jobs.finished(df).collect())
    assert got == brute_summaries(rows) and len(got) > 5
    assert jobs.finished(df.limit(0)).count() == 0


PAGE = """<html lang="ko-KR"><head><title>Night 크림 50ml | Acme Official</title><meta name="description" content="Retinol 50ml improves pore">
<script type="application/ld+json">{"@type":"Product","name":"Night 크림","brand":{"name":"Acme"},"category":"skincare","offers":[{"price":"38,000","priceCurrency":"KRW"}]}</script></head>
<body><p>add to cart</p> <p>₩ 38,000</p>""" + "<p>retinol serum 50ml improves pore and texture for dry skin, hyaluronic acid, in stock</p>" * 12 + "</body></html>"
URLS = {"good": "https://shop.example.co.kr/products/1", "blocked": "https://shop.example.co.kr/products/2", "lost": "https://shop.example.co.kr/products/3", "half": "https://shop.example.co.kr/products/4", "whole": "https://shop.example.co.kr/products/5"}


def generate(packs, mode, most):
    """Two rows for each wanted platform, and a report; the real generation has a test of its own."""
    labels = [("완전일치", "") for _ in range(2) if mode != "google_sa"] + [("", "exact") for _ in range(2) if mode != "naver_sa"]
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(i).alias("place"), F.concat(F.lit(f"{n or g} {i} "), "product_name").alias("keyword"), F.lit(n).alias("naver_match"), F.lit(g).alias("google_match")) for i, (n, g) in enumerate(labels)]
    chosen = packs.select("url", "product_name", F.explode(F.array(*rows)).alias("r")).select("url", "product_name", "r.*", F.lit("brand").alias("category"), F.lit("r").alias("reason"), F.lit(False).alias("quality_warning"))
    return chosen, packs.select("url", F.lit("COMPLETED").alias("status"), F.lit(None).cast("string").alias("failure_code"), F.lit(None).cast("string").alias("failure_detail"))


def result_rows(spark, root):
    return {(r.job_id, r.url_task_id): r for r in stages.table(spark, root, "results").collect()}


def files(folder):
    return sorted(str(p) for p in folder.rglob("*") if p.is_file() and "checkpoints" not in str(p))


@pytest.fixture(scope="module")
def drained(spark, tmp_path_factory):
    """Two jobs through all three queues, with unknown and repeated messages."""
    folder = tmp_path_factory.mktemp("service")
    root = str(folder)
    row = {"url": "u", "product_name": "p", "category": "brand", "keyword": "cached", "naver_match": "완전일치", "google_match": "", "reason": "r", "quality_warning": False}
    google = row | {"naver_match": "", "google_match": "exact"}
    cached = [(URLS["half"], "naver_sa", "commerce_pdp", [row]), (URLS["whole"], "naver_sa", "commerce_pdp", [row]), (URLS["whole"], "google_sa", "commerce_pdp", [google])]
    spark.createDataFrame(cached, stages.COMPONENT).write.parquet(f"{root}/cache/batch=0")
    requests = [("j1", [*URLS.values(), URLS["half"] + "?utm_source=x"], "both", '{"email":"a@b.c"}'), ("j2", [URLS["whole"]], "naver_sa", None)]
    asked = spark.createDataFrame(requests, "job_id string, urls array<string>, mode string, target string").withColumn("ts", F.current_timestamp())
    stages.submit(asked, root, "one")
    (folder / "queue/collection/odd.json").write_text("\n".join(json.dumps(m) for m in ({"job_id": "j1", "task_id": "unknown"}, {"job_id": "none", "task_id": "x"}, {"job_id": "j1", "task_id": None}, {"job_id": "j1", "task_id": "ut_j1_01"})))
    pages = spark.createDataFrame([(URLS["good"], PAGE), (URLS["half"], PAGE), (URLS["half"] + "?utm_source=x", PAGE), (URLS["blocked"], "<html><title>Access Denied</title><body>captcha robot check</body></html>")], "url string, html string")
    fetch = stages.from_pages(pages)
    stages.drain(spark, root, fetch, most=20, generate=generate)
    return folder, asked, fetch


def test_submission_and_transform(spark, drained):
    root = str(drained[0])
    got = result_rows(spark, root)
    assert {k: (r.generate, r.cache_hit) for k, r in got.items()} == {("j1", "ut_j1_01"): ("both", False), ("j1", "ut_j1_02"): ("both", False), ("j1", "ut_j1_03"): ("both", False), ("j1", "ut_j1_04"): ("google_sa", False), ("j1", "ut_j1_05"): ("", True), ("j1", "ut_j1_06"): ("google_sa", False), ("j2", "ut_j2_01"): ("", True)}
    assert got["j1", "ut_j1_05"].status == got["j2", "ut_j2_01"].status == "COMPLETED_CACHED"
    assert [r.keyword for r in got["j1", "ut_j1_05"].rows] == ["cached", "cached"] and len(got["j2", "ut_j2_01"].rows) == 1
    assert (got["j1", "ut_j1_03"].status, got["j1", "ut_j1_03"].failure_detail) == ("FAILED_COLLECTION", "page not found")
    assert got["j1", "ut_j1_02"].status == "FAILED_COLLECTION" and got["j1", "ut_j1_02"].failure_code
    for t in ("ut_j1_01", "ut_j1_04", "ut_j1_06"):
        assert got["j1", t].status == "COMPLETED" and got["j1", t].page_class == "image_heavy_commerce_pdp", got["j1", t]
    # a partial hit generates rows for the lacking platform only, after the cached ones
    sides = lambda t: [(r.naver_match, r.google_match) for r in got["j1", t].rows]
    assert sides("ut_j1_04") == sides("ut_j1_06") == [("완전일치", "")] + [("", "exact")] * 2
    assert sides("ut_j1_01") == [("완전일치", "")] * 2 + [("", "exact")] * 2 and got["j1", "ut_j1_04"].rows[0].keyword == "cached"
    held = {(r.canonical_url, r.platform): len(r.rows) for r in stages.table(spark, root, "cache").collect()}
    assert held[URLS["good"], "naver_sa"] == held[URLS["good"], "google_sa"] == held[URLS["half"], "google_sa"] == 2 and (URLS["blocked"], "naver_sa") not in held


def test_transform_generates_the_lacking_platform(spark):
    tasks = spark.createDataFrame([("j", "t", URLS["good"], URLS["good"], "both", "google_sa")], "job_id string, task_id string, raw_url string, canonical_url string, mode string, generate string")
    (r,) = stages.handle(tasks, stages.from_pages(spark.createDataFrame([(URLS["good"], PAGE)], "url string, html string")), spark.createDataFrame([], stages.COMPONENT), 20).collect()
    assert r.status in ("COMPLETED", "FAILED_GENERATION") and r.rows and all(x.naver_match == "" and x.google_match for x in r.rows)


def test_jobs_end_once_and_notify_once(spark, drained):
    folder, root = drained[0], str(drained[0])
    ended = {r.job_id: r for r in stages.table(spark, root, "finished").collect()}
    got = result_rows(spark, root)
    good = sum(r.status in ("COMPLETED", "COMPLETED_CACHED") for (j, _), r in got.items() if j == "j1")
    assert set(ended) == {"j1", "j2"} and (ended["j1"].submitted, ended["j1"].succeeded, ended["j1"].failed, ended["j1"].cached) == (6, good, 6 - good, 1)
    assert (ended["j1"].status, ended["j2"].status) == ("PARTIAL_COMPLETED", "COMPLETED")
    notes = stages.table(spark, root, "outbox").collect()
    assert [(n.job_id, json.loads(n.target)) for n in notes] == [("j1", {"email": "a@b.c"})] and json.loads(notes[0].payload)["status"] == "PARTIAL_COMPLETED"
    assert len(list(folder.glob("artifacts/*/manifest/*.json"))) >= 1


def test_nothing_changes_when_run_again(spark, drained):
    folder, asked, fetch = drained
    root, before = str(folder), files(folder)
    stages.submit(asked, root, "one")
    for name in ("collection", "aggregation", "notification"):
        for log in (folder / f"checkpoints/{name}/commits").glob("*[0-9]"):  # the last batch was not committed
            if int(log.name) == max(int(p.name) for p in (folder / f"checkpoints/{name}/commits").glob("*[0-9]")):
                last = log
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    stages.drain(spark, root, fetch, most=20, generate=generate)
    assert files(folder) == before
    # the same messages, delivered again
    (folder / "queue/collection/again.json").write_text(json.dumps({"job_id": "j1", "task_id": "ut_j1_01"}))
    (folder / "queue/notification/again.json").write_text(json.dumps({"job_id": "j1"}))
    (folder / "queue/aggregation/again.json").write_text(json.dumps({"job_id": "j1", "task_id": "ut_j1_01", "status": "COMPLETED", "ts": "2030-01-01T00:00:00"}))
    stages.drain(spark, root, fetch, most=20, generate=generate)
    assert [f for f in files(folder) if "again" not in f] == before
