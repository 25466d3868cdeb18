"""Worked examples of single rules."""

import pytest
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import keywords as K
from keyloom.functions import web
from keyloom.operators import accuracy, facts, jobs, quota, rows


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Shop.Example.com:443//a//b/?utm_source=x&b=2&a=1&ref=z#f", "https://shop.example.com/a/b?a=1&b=2"),
        ("http://user@h.com:8080", "http://h.com:8080/"),
        ("https://h.com/x/?empty=&fbclid=1", "https://h.com/x"),
        ("https://a.com/p?id=abc==", "https://a.com/p?id=abc%3D%3D"),
        ("https://a.com/p?d=100%zz&a=~x*y z", "https://a.com/p?a=~x%2Ay+z&d=100%25zz"),
        ("http://h.com:0080/", "http://h.com/"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, web.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize("k, want", [("a b a", True), ("a b a b", True), ("14 14", False), ("x y", False), ("", False), ("a a", True), ("1 2 3", False)])
def test_repeated_phrase(spark, k, want):
    assert one(spark, K.repeated_phrase(F.col("k")), k=k) is want


@pytest.mark.parametrize("k, want", [("X 가이드", "x"), ("X 추천 정보", "x 추천"), ("추천 후기", "추천 후기"), ("", "")])
def test_semantic_signature(spark, k, want):
    assert one(spark, K.semantic_signature(F.col("k")), k=k) == want


def test_policy_token_keeps_mixed_words_whole(spark):
    assert one(spark, K.tokens(F.col("k")), k="닭100g it's") == ["닭100g", "it's"]


def test_price_bands(spark):
    assert one(spark, K.price_bands(F.col("p")), p=38000) == ["3만원대", "30,000원대"]
    assert one(spark, K.price_bands(F.col("p")), p=900) == []


def test_largest_remainder_example(spark):
    plan = quota.largest_remainder(spark.createDataFrame([(160,)], "total int"), quota.categories(spark))
    got = {r.category: r.seats for r in plan.collect()}
    assert got == {"brand": 16, "generic_category": 19, "feature_attribute": 29, "competitor_comparison": 13, "purchase_intent": 19, "long_tail": 25, "benefit_price": 10, "season_event": 10, "problem_solution": 19}


@pytest.mark.parametrize("total", [0, 5, 9, 10, 37, 100, 101, 1000])
def test_largest_remainder_gives_all_seats(spark, total):
    seats = quota.largest_remainder(spark.createDataFrame([(total,)], "total int"), quota.categories(spark)).agg(F.sum("seats")).first()[0]
    assert seats == (0 if total == 0 else max(total, len(dims.CATEGORY_TARGETS)))


def test_divisor_plan_equals_the_loop(spark):
    import random

    random.seed(5)
    demand = [(k, random.randint(1, 30), p, f"c{p}", random.randint(1, 9), random.randint(0, 6), random.choice([0.5, 1.0, 1.25])) for k in range(30) for p in range(5)]
    demand = [(k, demand[k * 5][1], p, c, t * s, a, t, s) for k, _, p, c, t, a, s in demand]
    got = {(r.key, r.category): r.seats for r in quota.divisor_plan(spark.createDataFrame(demand, "key int, total int, pos int, category string, weight double, available int, target int, strength double")).collect()}
    for key in range(30):
        active = [x for x in demand if x[0] == key and x[5] > 0]
        total = active[0][1] if active else 0
        plan = {x[3]: 0 for x in active}
        if total < len(active):
            for x in sorted(active, key=lambda x: (-x[7], -x[6], x[3]))[:total]:
                plan[x[3]] = 1
        else:
            plan = dict.fromkeys(plan, 1)
            for _ in range(total - len(active)):
                free = [x for x in active if plan[x[3]] < x[5]]
                if not free:
                    break
                best = max(free, key=lambda x: (x[4] / (plan[x[3]] + 0.5), x[5] - plan[x[3]], x[6], -x[2]))
                plan[best[3]] += 1
        assert {c: got[key, c] for c in plan} == plan


def test_weak_ratio_fails_validation(spark):
    data = [("u", i, "brand", f"word{i} x{i}y", "확장소재", "broad", "weak" if i < 21 else "direct", "p", "b", "") for i in range(100)] + [("u", 100, "negative", "중고", "제외키워드", "negative", None, "p", "b", "")]
    df = spark.createDataFrame(data, "url string, ord int, category string, keyword string, naver_match string, google_match string, evidence_tier string, product_name string, brand string, reason string")
    got = rows.validation(df).collect()
    assert {r.failure_detail for r in got} == {"naver_sa weak-tier ratio exceeded 20%", "google_sa weak-tier ratio exceeded 20%"} and {r.status for r in got} == {"FAILED_GENERATION"}
    report = rows.validation_report(rows.validation(df)).first()
    assert (report.status, report.failure_detail, report.least_positives) == ("FAILED_GENERATION", "naver_sa weak-tier ratio exceeded 20%", 100)


def test_auto_score_by_hand(spark):
    df = rows.keyword_rows(spark.createDataFrame([("u", "ring", "Acme", "GOLD")], "url string, product_name string, brand string, type string"))
    r = rows.url_metrics(df).where("platform = 'naver_sa'").first()
    counts = {c: 0 for c in dims.IDEAL_SHARES}
    for t in dims.TEMPLATES:
        if t[1] != "negative":
            counts[t[1]] += 1
    n = sum(counts.values())
    dev = sum(abs(counts[c] / n - s) for c, s in dims.IDEAL_SHARES.items()) / 9
    want = max(0, r.natural_sum / (n * 100) * 30 + max(0, 10 - dev * 100) + r.semantic_distinct / n * 10 + r.reasoned / n * 10 - r.fillers / n * 60 - r.malformed * 1.5 - r.invalid_negatives * 0.5)
    assert r.deviation == pytest.approx(dev) and r.auto_score == pytest.approx(want)


def test_merged_lines_equals_the_loop(spark):
    import random

    random.seed(2)
    data = [(i, t, o, "w" * random.randint(0, 45)) for i in range(4) for t in range(3) for o in range(20)]
    got = {(r.image, r.tile, r.group_no): (r.text, r.blocks) for r in accuracy.merged_lines(spark.createDataFrame(data, "image int, tile int, ord int, text string")).collect()}
    want = {}
    for i in range(4):
        for t in range(3):
            groups: list[list[str]] = []
            for x in (d[3] for d in data if d[:2] == (i, t)):
                g = groups[-1] if groups else None
                if g and len(g) < 3 and len(" ".join(g)) + len(x) <= 96 and all(len(y) <= 32 for y in g) and len(x) <= 32:
                    g.append(x)
                else:
                    groups.append([x])
            want |= {(i, t, k): (" ".join(g), len(g)) for k, g in enumerate(groups)}
    assert got == want


def test_facts_and_jobs_on_empty_tables(spark):
    empty = spark.createDataFrame([], "url string, ord int, type string, value string")
    assert facts.distinct_facts(empty).count() == 0
    assert jobs.status_counts(spark.createDataFrame([], "job_id int, task_id int, status string")).count() == 0
    assert rows.validation(rows.keyword_rows(spark.createDataFrame([], "url string, product_name string, brand string, type string"))).count() == 0
