"""Results read by manifest: relative and absolute paths, web addresses, missing and broken artifacts, jobs with and without a combined file."""

import json

import pytest
from pyspark.sql import functions as F

from keyloom.sources import artifacts
from tests.test_scan import server  # noqa: F401  a local web server

ROW = ("u", "p", "brand", "k", "x", "", "r", False)


def test_jobs_by_manifest(spark, tmp_path):
    data = [(j, f"t{i}", f"https://x/{j}/{i}", "commerce_pdp", "FAILED_COLLECTION" if i == 2 else "COMPLETED", "c" if i == 2 else None, [ROW] if i < 2 else []) for j in ("a", "b", "c") for i in range(3)]
    results = spark.createDataFrame(data, artifacts.RESULT)
    root = str(tmp_path / "jobs here")
    artifacts.write_items(results, root)
    artifacts.write_combined(results.where("job_id = 'a'"), root)
    got = {(r.job_id, r.url_task_id): r for r in artifacts.read_jobs(spark, root).collect()}
    assert {k: (r.source, r.status) for k, r in got.items()} == {("a", "t0"): ("combined", "COMPLETED"), ("a", "t1"): ("combined", "COMPLETED"), **{(j, f"t{i}"): ("manifest", "FAILED_COLLECTION" if i == 2 else "COMPLETED") for j in "bc" for i in range(3)}}
    assert all(r.error is None and r.raw_url.startswith("https://x/") for r in got.values()) and got["b", "t1"].rows[0].keyword == "k" and got["c", "t2"].failure_code == "c"


def test_items_that_are_odd(spark, tmp_path, server):  # noqa: F811
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "one.json").write_text(json.dumps({"raw_url": "one"}))
    (tmp_path / "deep" / "er" / "bad.json").write_text("not json")
    rows = [("j", "rel", "", "deep/er/one.json"), ("j", "slash", None, "/deep/er/one.json"), ("j", "abs", "COMPLETED", f"file://{tmp_path}/deep/er/one.json"), ("j", "bad", "COMPLETED", "deep/er/bad.json"), ("j", "gone", "COMPLETED", "deep/er/none.json"), ("j", "nowhere", "COMPLETED", "no/such/folder.json"), ("j", "blank", "COMPLETED", " "), ("j", "null", "COMPLETED", None), ("j", "web", "COMPLETED", f"{server}/page"), ("j", "web404", "COMPLETED", f"{server}/gone")]
    items = spark.createDataFrame(rows, artifacts.ITEM)
    got = {r.url_task_id: (r.payload, r.error) for r in artifacts.read_items(spark, items, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert got["rel"][0] == got["slash"][0] == got["abs"][0] == '{"raw_url": "one"}' and got["bad"] == ("not json", None)
    assert all(got[k][0] is None and got[k][1].startswith("no artifact at") for k in ("gone", "nowhere")) and got["blank"][1] == got["null"][1] == "no artifact named"
    assert got["web"] == ("<html><title>/page</title></html>", None) and got["web404"] == (None, "status 404")
    assert artifacts.read_items(spark, items.limit(0), str(tmp_path)).count() == 0


def test_too_many_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "MOST_FOLDERS", 3)
    items = spark.range(5).select(F.lit("j").alias("job_id"), F.lit("t").alias("url_task_id"), F.lit("").alias("status"), F.concat(F.lit("d"), "id", F.lit("/x/y.json")).alias("artifact"))
    with pytest.raises(ValueError):
        artifacts.read_items(spark, items, str(tmp_path))
