"""Pages to keywords on literal rows, against loops and worked examples."""

import html
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import web
from keyloom.functions.arrays import unique
from keyloom.operators import bank, evidence, images, intents, interpret, labels, pages, recognised, resolve, rows
from keyloom.plans import deep
from keyloom.sources import fetch
from tests.conftest import SF

PAGE = """<html lang="ko"><head><title>Night Cream 50ml | Acme Official</title><meta name="description" content="Retinol cream 50ml, 100ml improves wrinkle, pore"><script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"Acme  Night Cream","brand":{"name":"Acme (KR)"},"offers":{"price":"38,000"},"category":"Face Cream"}]}</script><script>var captcha = 1;</script></head><body><p>Night Cream ₩ 38,000 add to cart</p><p>BEST SELLER</p><p>retinol 50ml ceramide for dry skin</p></body></html>"""


def test_references_resolve_as_in_the_standard_library(spark):
    random.seed(1)
    names = list(html.entities.html5)
    part = lambda: random.choice(["&" + random.choice(names), "&" + random.choice(names).rstrip(";"), "x", ";", " ", f"&#{random.randint(0, 70000)};", f"&#x{random.randint(0, 70000):x}"])
    made = ["", "&", "&#99999999999999999999;", "&notit;&amp;lt;&copy2"] + ["".join(part() for _ in range(6)) for _ in range(1000)]
    got = spark.createDataFrame([(t,) for t in made], "t string").select("t", web.unescape(F.col("t")).alias("u")).collect()
    assert all(r.u == html.unescape(r.t) for r in got)


def test_unique_keeps_the_first_in_order(spark):
    random.seed(2)
    values = [random.choice("aAbBcC dD") + random.choice(["", " ", "\u00a0x"]) for _ in range(300)]
    want, seen = [], set()
    for v in (" ".join(x.split()) for x in values):
        if v and v.lower() not in seen:
            seen.add(v.lower())
            want.append(v)
    assert spark.createDataFrame([(values,)], "v array<string>").select(unique(F.col("v")).alias("u")).first().u == want


def test_a_page_becomes_a_pack(spark):
    df = spark.createDataFrame([(1, "https://www.laneige.com/products/1", PAGE), (2, "https://x.co.kr/a", "<title>x</title>"), (3, "https://y.com", None), (4, "https://z.com/", "<html><body>window.awsWafCookieDomainList</body></html>")], "page_id long, url string, html string")
    snap = {r.page_id: r for r in pages.classified(df).select("page_id", "page_class", "has_schema", "ko", "blocker").collect()}
    assert snap[1].page_class == "image_heavy_commerce_pdp" and snap[1].has_schema and snap[1].ko >= 0.6 and snap[1].blocker == []
    assert snap[4].page_class == "blocked_page"
    packs, failures = resolve.resolve(df)
    pack = packs.collect()
    assert [p.page_id for p in pack] == [1] and pack[0].product_name == "Acme Night Cream"
    facts = [(f.type, f.value, f.confidence) for f in pack[0].facts]
    assert facts[0] == ("brand", "Acme", 0.99) and ("price", "38000", 0.9) in facts and ("product_category", "Face Cream", 0.93) in facts and ("volume", "50ml", 0.92) in facts
    assert len({(k, v.lower()) for k, v, _ in facts}) == len(facts)
    lost = {r.page_id: r for r in failures.collect()}
    assert lost[3].failure_code == "collection_fetch_failed" and lost[4].hints[0].startswith("the collector reached a blocker") and lost[2].page_class == "non_product_page"


def test_rendered_pages_replace_thin_ones(spark):
    first = spark.createDataFrame([(1, "https://a.com/products/1", "<title>x</title>", None), (2, "https://b.com/", None, "timed out"), (3, "https://c.com/", None, "dns")], "page_id long, url string, html string, error string")
    body = "<p>Night Cream add to cart ₩ 38,000</p>" + "<p>long words about the cream here</p>" * 20
    again = spark.createDataFrame([(1, "https://a.com/products/1", "<title>Night Cream 50ml</title><p>x</p>", body, None), (2, "https://b.com/", None, None, "empty html")], "page_id long, url string, html string, cleaned_html string, error string")
    packs, failures = resolve.resolve(first, again)
    pack = packs.first()
    assert pack.page_id == 1 and "fallback_used" in pack.warnings and "preprocessing_source:cleaned_html" in pack.warnings and pack.sellability_state == "sellable"
    lost = {r.page_id: r.hints for r in failures.collect()}
    assert set(lost) == {2, 3} and any("no usable DOM" in h for h in lost[2]) and any("DNS" in h for h in lost[3])


def test_images_give_the_first_source_not_seen(spark):
    body = "<img src='/blank.gif' data-src='/a.jpg, /b.jpg 2x'><img src=\"/blank.gif\" data-src=\"../up/./c.jpg?x=1,2\" width='300px'><img src='/blank.gif'>"
    got = images.image_candidates(spark.createDataFrame([(1, "https://h.com/p/q/r.html", body)], "page_id int, url string, html string")).orderBy("dom_index").collect()
    assert [(r.src, r.attribute, r.width) for r in got] == [("https://h.com/blank.gif", "src", None), ("https://h.com/p/up/c.jpg?x=1,2", "data-src", 300)]


def test_picks_follow_plan_and_signatures():
    judged = [{"pos": p, "signature": s, "rejected": r} for p, s, r in [(0, "a", False), (0, "b", True), (0, "c", False), (1, "a", False), (1, "d", False), (1, "e", False), (2, "c", False)]]
    assert bank.picks(judged, {0: 1, 1: 1}, [1.0] * 9) == [0, 4, 6]
    assert bank.picks(judged, {0: 2, 1: 4}, [1.0] * 9) == [0, 2, 4, 5]
    assert bank.picks([], {0: 3}, [1.0] * 9) == []


def test_generation_keeps_its_rules(spark):
    packs = deep.product_packs(spark, SF).where("p_partkey < 30")
    chosen, report = intents.generate(packs, "both", 20)
    got = chosen.collect()
    by = {}
    for r in got:
        by.setdefault(r.url, []).append(r)
    assert len(by) == 30
    for own in by.values():
        positive = [r for r in own if r.category != "negative"]
        assert len(positive) <= 20 and len({r.category for r in positive[:1]}) and not any(r.hard_issues for r in own)
        assert len({bank_signature(r.keyword) for r in positive}) == len(positive)
        assert {r.category for r in positive} >= {"brand", "generic_category", "purchase_intent", "problem_solution"}
    assert {r.failure_code for r in report.collect()} == {"generation_count_shortfall"}
    only = intents.generate(packs.where("p_partkey < 3"), "naver_sa", 20)[0].collect()
    assert only and all(r.google_match == "" and r.naver_match for r in only)
    with pytest.raises(ValueError):
        intents.generate(packs, "other")
    spark.catalog.clearCache()


def bank_signature(keyword):
    words = [w for w in keyword.replace("|", " ").lower().split()]
    return " ".join(words)


def test_selection_counts_each_platform(spark):
    data = [("u", i, "brand" if i < 3 else "long_tail", f"k{i}", "완전일치" if i % 2 == 0 else "", "exact" if i % 3 else "", 9000 - i, "direct") for i in range(12)]
    df = spark.createDataFrame(data, "url string, ord int, category string, keyword string, naver_match string, google_match string, score int, evidence_tier string")
    chosen = [r.ord for r in rows.select_rows(df, 3).orderBy("place").collect()]
    n = g = 0
    want, first = [], {}
    fits = lambda x: (x[4] or x[5]) and not (x[4] and n >= 3) and not (x[5] and g >= 3)
    order = []
    for c in ("brand", "long_tail"):
        order += [(c, x) for x in data if x[2] == c]
    for c, x in order:
        if c not in first and fits(x):
            first[c] = x[1]
            want.append(x[1])
            n, g = n + bool(x[4]), g + bool(x[5])
    for x in data:
        if x[1] not in want and fits(x):
            want.append(x[1])
            n, g = n + bool(x[4]), g + bool(x[5])
    assert chosen == want


def test_lost_heads_come_back(spark):
    packs = deep.product_packs(spark, SF).where("p_partkey < 6 and p_size % 3 = 0")
    banked = bank.with_bank(interpret.interpreted(packs)).persist()
    url = banked.first().url
    fields = "url string, ord int, category string, keyword string, slot_type string, naver_match string, google_match string, reason string, evidence_tier string, quality_score string"
    row = lambda i, k: (url, i, "generic_category", k, "generic_type_phrase", "확장소재", "broad", "r", "inferred", None)
    stayed, sources = spark.createDataFrame([row(0, "민감 피부 레티놀 크림")], fields), spark.createDataFrame([row(0, "민감 피부 레티놀 크림"), row(1, "레티놀 크림")], fields)
    assert sorted(r.keyword for r in intents.restored_heads(stayed, sources, banked).collect()) == ["레티놀 크림", "민감 피부 레티놀 크림"]
    banked.unpersist()


def test_lines_group_as_the_loop_does(spark):
    random.seed(3)
    data = [(1, f"i{random.randint(0, 1)}", random.randint(0, 1), o, "w" * random.randint(1, 45), "table_like_image" if o % 5 == 0 else "general_detail_image") for o in range(60)]
    df = spark.createDataFrame(data, "page_id int, image_src string, tile_index int, block_order int, text string, candidate_type string")
    df = df.selectExpr("*", "'plain_text' pipeline_type", "'original' preprocessing_variant", "array('acme') matched", "0.5D text_quality", "0.5D same_product", "0.7D layout_trust", "0.5D score", "true direct")
    got = [(r.image_src, r.tile_index, r.text) for r in recognised.line_groups(df).orderBy("ordinal").collect()]
    want = []
    for key in sorted({(x[1], x[2]) for x in data}):
        now = []
        for x in sorted((x for x in data if (x[1], x[2]) == key), key=lambda x: x[3]):
            if now and now[0][5] != "table_like_image" and len(now) < 3 and all(len(y[4]) <= 32 for y in now) and len(x[4]) <= 32 and len(" ".join(y[4] for y in now)) + len(x[4]) <= 96:
                now.append(x)
            else:
                want += [(*key, " ".join(y[4] for y in now))] if now else []
                now = [x]
        want += [(*key, " ".join(y[4] for y in now))] if now else []
    assert got == want


def test_labels_lie_beside_images_or_mirrored(spark):
    files = spark.createDataFrame([(p,) for p in ("d/images/a.jpg", "d/images/b.png", "d/c.jpg", "d/c_upscale_x2.jpg", "d/x.txt", "d/images/n.jpg")], "path string")
    texts = spark.createDataFrame([("d/images/a.txt", "A"), ("d/texts/b.txt", "B"), ("d/c.json", "C"), ("d/texts/n.txt", " ")], "path string, text string")
    assert sorted(map(tuple, labels.labelled_images(files, texts).collect())) == [("d/c.jpg", "C"), ("d/images/a.jpg", "A"), ("d/images/b.png", "B")]


def test_fetchers_are_tried_in_turn(spark):
    def broken(url):
        raise OSError("no route")

    def second(url):
        return {"html": "<p>x</p>" if "a" in url else "", "http_status": 404 if "a" in url else None}

    got = {r.raw_url: r for r in fetch.fetch_pages(spark.createDataFrame([("http://a",), ("http://b",)], "url string"), [("desktop", broken), ("plain", second)]).collect()}
    assert (got["http://a"].fetch_profile, got["http://a"].http_status, got["http://a"].error) == ("plain", 404, None)
    assert got["http://b"].html is None and got["http://b"].error == "empty html"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    packs, failures = resolve.resolve(empty)
    assert packs.count() == 0 and failures.count() == 0
    assert evidence.numbered(packs).count() == 0


def test_refused_heads_do_not_use_up_the_limit(spark):
    packs = deep.product_packs(spark, SF).where("p_partkey < 6 and p_size % 3 = 0")
    banked = bank.with_bank(interpret.interpreted(packs)).limit(1).persist()
    url = banked.first().url
    refused = "무료배송 크림"
    banked = banked.withColumn("category_terms", F.array(F.lit(refused), F.lit("레티놀 크림")))
    fields = "url string, ord int, category string, keyword string, slot_type string, naver_match string, google_match string, reason string, evidence_tier string, quality_score string"
    row = lambda i, k: (url, i, "generic_category", k, "generic_type_phrase", "확장소재", "broad", "r", "inferred", None)
    long = f"민감 피부 {refused}"
    stayed = spark.createDataFrame([row(0, "민감 피부 레티놀 크림"), row(3, long)], fields)
    sources = spark.createDataFrame([row(0, "민감 피부 레티놀 크림"), row(1, "레티놀 크림"), row(2, refused)], fields)
    back = {r.keyword for r in intents.restored_heads(stayed, sources, banked, most=1).collect()}
    assert "레티놀 크림" in back and refused not in back
