"""Requests over the queues' tables: refusals, a submitted job, its state before and after the end."""

import json

import pytest

from keyloom.streaming import handlers, stages

ROW = {"url": "u", "product_name": "p", "category": "brand", "keyword": "cached", "naver_match": "완전일치", "google_match": "", "reason": "r", "quality_warning": False}
PAGE = "https://shop.example.co.kr/products/1"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("service"))
    spark.createDataFrame([(PAGE, "naver_sa", "commerce_pdp", [ROW])], stages.COMPONENT).write.parquet(f"{at}/cache/batch=0")
    return at


@pytest.mark.parametrize("event, code", [({"body": "{"}, 400), ({"body": "[]"}, 400), ({"body": None}, 400), ({"body": {"urls": ["u"] * 31}}, 422), ({"body": '{"urls": ["u"], "requested_platform_mode": "x"}'}, 422), ({"body": {"urls": ["u"], "notification_target": {}}}, 400)])
def test_requests_that_are_refused(spark, root, event, code):
    got = handlers.route(spark, root, event | {"httpMethod": "POST", "path": "/jobs"})
    assert got["statusCode"] == code and json.loads(got["body"])["error"]


def test_paths_and_methods(spark, root):
    asked = lambda method, path: handlers.route(spark, root, {"httpMethod": method, "path": path})["statusCode"]
    assert [asked("GET", "/jobs"), asked("POST", "/jobs/x"), asked("GET", "/"), asked("GET", "/jobs/a/b"), asked("GET", "/jobs/unknown")] == [405, 405, 404, 404, 404]
    assert handlers.get_job(spark, root, {"pathParameters": {"job_id": " "}})["statusCode"] == 400


def test_a_job_from_request_to_end(spark, root):
    body = {"urls": [PAGE + "?utm_source=x"], "requested_platform_mode": "naver_sa", "notification_target": {"webhook": "https://hook"}}
    made = handlers.route(spark, root, {"httpMethod": "post", "path": "/jobs/", "body": json.dumps(body)})
    said = json.loads(made["body"])
    assert (made["statusCode"], said["status"], said["submitted_count"], said["cached_count"]) == (202, "RECEIVED", 1, 1)
    ask = lambda url: json.loads(handlers.route(spark, root, {"path": url})["body"])
    before = ask(said["status_url"])
    assert before["status"] == "RECEIVED" and before["counts"]["succeeded"] == 0 and not any(before["artifacts"].values())
    assert before["notification"] == {"target_type": "webhook", "value": "https://hook", "sent": False}
    (task,) = before["url_tasks"]
    assert (task["status"], task["cache_hit"], task["page_class"]) == ("COMPLETED_CACHED", True, "commerce_pdp")
    other = json.loads(handlers.submit_job(spark, root, {"body": {"urls": [PAGE]}})["body"])
    stages.aggregation(spark, root)
    stages.notification(spark, root)
    after = ask(said["status_url"])
    assert after["status"] == "COMPLETED" and after["counts"] == {"submitted": 1, "cached": 1, "succeeded": 1, "failed": 0} and after["notification"]["sent"]
    assert spark.read.json(after["artifacts"]["combined_json_url"]).count() == 1 and after["artifacts"]["failures_json_url"] is None
    still = ask(other["status_url"])
    assert still["status"] == "PROCESSING" and [t["status"] for t in still["url_tasks"]] == ["RECEIVED"] and still["notification"] is None
