"""Images, identity, JSON-LD, character sets, requests and hooks on literal rows."""

import pytest
from pyspark.sql import functions as F

from keyloom import api
from keyloom.functions import structured
from keyloom.operators import images, product
from keyloom.sources import files

PAGE = """<html><head><script type="application/ld+json">{"@graph": [{"@type": ["Product", "Thing"], "name": "Night  Mask", "brand": {"name": "Acme"}, "offers": [{"price": 38000}]}, {"@type": "BreadcrumbList"}]}</script>
<script type='application/ld+json'>not json</script></head></html>"""


def test_json_ld_signals(spark):
    df = spark.createDataFrame([(PAGE,), ("",), (None,)], "html string")
    r = df.select(F.size(structured.json_ld(F.col("html"))).alias("n"), structured.structured_signals(structured.json_ld_texts(F.col("html"))).alias("s")).collect()
    assert r[0].n == 1 and r[0].s.payloads == 1 and r[0].s.has_product
    assert (r[0].s.name, r[0].s.fact_name, r[0].s.fact_brand, r[0].s.fact_price) == ("Night  Mask", "Night Mask", "Acme", "38000")
    assert [(x.s.payloads, x.s.has_product, x.s.name) for x in r[1:]] == [(0, False, None)] * 2


def test_walk_keeps_the_order_of_nested_graphs():
    value = [{"@id": 1, "@graph": [{"@id": 2}, [{"@id": 3, "@graph": [{"@id": 4}]}]]}, "x", {"@id": 5}]
    assert [n["@id"] for n in structured.walk(value)] == [1, 2, 3, 4, 5]
    assert structured.page_signals(["[" * 100000, "1", "null"])["payloads"] == 2


@pytest.mark.parametrize("raw, og, ld, want", [("Shop", "Acme Mask", "x", "Acme Mask"), ("Night Mask Pro", "o", "x", "Night Mask Pro"), ("Mask 2", "o", None, "Mask 2"), ("", None, "ld", "ld"), ("captcha", "o", None, "captcha"), (None, None, None, None)])
def test_resolved_title(spark, raw, og, ld, want):
    df = spark.createDataFrame([(raw, og, ld)], "raw string, og string, ld string")
    assert df.select(structured.resolved_title(F.col("raw"), F.col("og"), F.col("ld")).alias("t")).first().t == want


def test_decode_body(spark):
    rows = [(bytearray("가격 할인 <html>".encode("cp949")), "text/html; charset=cp949"), (bytearray("plain é".encode()), None), (None, None), (bytearray('<meta charset="cp949"><title>가격</title>'.encode("cp949")), "text/html"), (bytearray("가격".encode()), "text/html; charset=no-such")]
    got = [x.d for x in spark.createDataFrame(rows, "b binary, c string").select(structured.decode_body("b", "c").alias("d")).collect()]
    assert got[0].text.startswith("가격") and got[0].charset == "cp949" and got[1].text == "plain é" and got[1].charset == "utf-8" and got[2].text is None
    assert got[3].charset == "cp949" and "가격" in got[3].text and got[4].text == "가격" and got[4].flags == []
    assert structured.damage("Ã©") == ["utf8_latin1_mojibake"]


def test_images_rank_by_score_and_keep_each_source_once(spark):
    html = '<img src="/a/logo.png"><img src="/x/detail/1.webp" alt="size table" width="900" height="1000"><img data-src="/x/detail/1.webp"><img src="data:x"><img src="y.jpg" width="100" height="100"><img src="//cdn.z.com/y.jpg">'
    c = images.image_candidates(spark.createDataFrame([(1, "https://h.com/p/q.html", html)], "page_id int, url string, html string"))
    assert [r.src for r in c.orderBy("dom_index").collect()] == ["https://h.com/a/logo.png", "https://h.com/x/detail/1.webp", "https://h.com/p/y.jpg", "https://cdn.z.com/y.jpg"]
    r = images.ranked_images(c).orderBy("rank").collect()
    assert [x.src for x in r] == ["https://h.com/x/detail/1.webp", "https://cdn.z.com/y.jpg"]
    want = 0.9 + 0.35 + 1.4 + 0.15 + (0.15 - 0.02) + (15 + 55 + 20 + 8) / 100 * 0.45 + 0.55
    assert r[0].score == pytest.approx(want, abs=1e-4) and r[0].candidate_type == "table_like_image"


def test_competitor_and_types(spark):
    df = spark.createDataFrame([("Samsung 스마트폰 비교",), ("Acme 스마트폰",), ("Samsung",), ("Samsung 500 ml",)], "k string")
    types = F.array(F.lit("smartphone"))
    terms = product.competitor_terms(types, F.lit("Acme"), F.lit("https://acme.com"))
    ok = product.valid_competitor(F.col("k"), terms, F.array(F.lit("acme")), F.array(F.lit("스마트폰")), types)
    assert [r.v for r in df.select(ok.alias("v")).collect()] == [True, False, False, False]
    assert df.select(product.product_types(F.lit("레티놀 iPhone case")).alias("t")).first().t == ["skincare", "smartphone", "phone_case"]
    assert df.select(product.domain_mismatch(F.lit("업무용 크림"), F.array(F.lit("skincare"))).alias("v")).first().v


def test_taxonomy_terms_and_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"entry_id":"a","term":"중고","allowed_product_types":["*"],"required_anchor_tags":[]},{"entry_id":"b","term":"샘플","allowed_product_types":["skincare"],"required_anchor_tags":["commerce"]},{"entry_id":"c","term":" "}]')
    (tmp_path / "g.json").write_text('{"case_id":"x","platform_expectations":{"naver_sa":{"must_keep":["a","b"],"forbidden_substrings":["c"]}}}')
    (tmp_path / "p.json").write_text('{"raw_url":"u","facts":[{"type":"brand","value":"Acme"}]}')
    taxonomy = files.read_taxonomy(spark, str(tmp_path / "t.json"))
    packs = spark.createDataFrame([(1, ["skincare"], ["commerce"]), (2, ["skincare"], []), (3, ["audio"], [])], "key int, types array<string>, tags array<string>")
    assert sorted((r.key, r.term) for r in product.taxonomy_terms(packs, taxonomy).collect()) == [(1, "샘플"), (1, "중고"), (2, "중고"), (3, "중고")]
    assert sorted((r.kind, r.value) for r in files.read_golden(spark, str(tmp_path / "g.json")).collect()) == [("forbidden_substrings", "c"), ("must_keep", "a"), ("must_keep", "b")]
    fact = files.pack_facts(files.read_json(spark, str(tmp_path / "p.json"), files.PACK)).first()
    assert (fact.normalized_value, fact.evidence_tier, fact.confidence) == ("Acme", "direct", 0.8)


@pytest.mark.parametrize("body, code", [({"urls": ["http://a.com"]}, 202), ({}, 400), ({"urls": ["x"] * 31}, 422), ({"urls": ["x"], "requested_platform_mode": "z"}, 422), ({"urls": ["x"], "notification_target": {"email": "a", "webhook": "b"}}, 400), ({"urls": ["x"], "notification_target": {"email": "a"}}, 202)])
def test_check_request(body, code):
    assert api.check_request(body)[0] == code


def test_submit_and_hooks(spark):
    cache = spark.createDataFrame([("https://a.com/x", "naver_sa"), ("https://b.com/", "naver_sa"), ("https://b.com/", "google_sa")], "canonical_url string, platform string")
    got = api.submit(spark, "j", {"urls": ["https://A.com/x/?utm_a=1", "https://b.com", "https://c.com"]}, cache).orderBy("task_id").collect()
    assert [(r.route, r.generate) for r in got] == [("partial", "google_sa"), ("hit", ""), ("miss", "both")]
    with pytest.raises(ValueError):
        api.submit(spark, "j", {}, cache)
    cls = spark.createDataFrame([(1, "commerce_pdp"), (2, "blocked_page"), (3, "marketing_only_pdp")], "page_id int, page_class string")
    gated = api.product_gate(cls, lambda rows: ["true" if r["page_id"] == 1 else "false" for r in rows])
    assert sorted((r.page_id, r.page_class) for r in gated.collect()) == [(1, "commerce_pdp"), (2, "blocked_page"), (3, "non_product_page")]

    def broken(rows):
        raise OSError("no service")

    got = api.with_model(cls, broken).collect()
    assert [r.answer for r in got] == [None] * 3 and {r.answer_error for r in got} == {"OSError: no service"}

    def picky(rows):
        if any(r["page_id"] == 2 for r in rows):
            raise OSError("two")
        return ["ok"] * len(rows)

    assert sorted((r.page_id, r.answer) for r in api.with_model(cls.coalesce(1), picky).collect()) == [(1, "ok"), (2, None), (3, "ok")]

    def only_second(model, prompt):
        if model != "b":
            raise OSError(model)
        return prompt.upper()

    assert api.first_model(["a", "b", "c"], only_second)("x") == ("b", "X")
    with pytest.raises(OSError, match="c"):
        api.first_model(["a", "c"], only_second)("x")


def test_artifacts_round_trip_and_fall_back(spark, tmp_path):
    import shutil

    from keyloom.sources import artifacts

    row = ("u", "p", "brand", "k", "완전일치", "", "r", False)
    data = [("j1", "t1", "u", "commerce_pdp", "COMPLETED", None, [row, row]), ("j1", "t2", "v", "blocked_page", "FAILED_COLLECTION", "blocked", None), ("j2", "t3", "w", "commerce_pdp", "COMPLETED_CACHED", None, [row])]
    folder = str(tmp_path / "out")
    artifacts.write_job(spark.createDataFrame(data, artifacts.RESULT), folder)
    for _ in range(2):
        assert sorted((r.job_id, r.url_task_id) for r in artifacts.read_job(spark, folder).collect()) == [("j1", "t1"), ("j2", "t3")]
        assert artifacts.evaluation_rows(artifacts.read_job(spark, folder)).count() == 3
        shutil.rmtree(f"{folder}/combined", ignore_errors=True)
    manifest = {r.job_id: r.status for r in spark.read.json(f"{folder}/manifest").collect()}
    assert manifest == {"j1": "PARTIAL_COMPLETED", "j2": "COMPLETED"}
    csv = spark.read.option("header", True).csv(f"{folder}/csv")
    assert set(csv.columns) == {*__import__("keyloom.dims", fromlist=["x"]).EXPORT_COLUMNS, "job_id"} and csv.count() == 3
