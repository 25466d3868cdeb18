"""Model responses in their variants, and deduplication answers held against a plain loop."""

import hashlib
import json
import random

import pytest

from keyloom.functions import responses as R

ITEM = '{"category": "brand", "keyword": " Acme Mask ", "quality_score": "high"}'


@pytest.mark.parametrize(
    "text, n",
    [
        ('{"items": [%s]}' % ITEM, 1),
        ('{"keywords": [%s, %s]}' % (ITEM, ITEM), 2),
        ('```json\n{"intents": [%s]}\n```' % ITEM, 1),
        ('Sure: {"result": {"rows": [%s]}} done' % ITEM, 1),
        ("[%s]" % ITEM, 1),
        ("no json", 0),
        (None, 0),
        ('{"items": 3}', 0),
        ('{"notes": [{"a": 1}, {"b": 2}], "out": {"deep": [{"items": [%s]}]}}' % ITEM, 1),  # other lists come first
        ('{"keywords": [%s, %s], "items": [%s]}' % (ITEM, ITEM, ITEM), 1),  # by the order of names
        (json.dumps({"body": '```json\n{"items": [%s]}\n```' % ITEM}), 1),  # JSON within a text
        ('{"first": {"rows": []}, "items": [%s]}' % ITEM, 1),  # the outer object is met first
        ('{"items": [{"keyword": "no category"}, "text", null, %s]}' % ITEM, 1),
    ],
)
def test_items_are_found(text, n):
    assert len(R.find_items(R.outer_json(text))) == n


def test_rows_of_the_older_form_and_platforms():
    (row,) = R.find_items({"rows": [{"category": "brand", "keyword": "k", "naver_match": "완전일치", "google_match": ""}]})
    assert (row["platforms"], row["naver_match"], row["google_match"]) == (["naver_sa"], "완전일치", None)
    scopes = [x["platforms"] for x in R.find_items({"items": [{"category": "c", "keyword": "k", "platform_scope": s} for s in ("both", "google_sa", "x", None)]})]
    assert scopes == [["naver_sa", "google_sa"], ["google_sa"], None, None]


def test_parsed_rows(spark):
    answers = spark.createDataFrame([("u", '{"items": [%s, {"category": "x"}]}' % ITEM), ("v", "bad"), ("w", None)], "url string, answer string")
    rows = R.parsed_rows(answers).collect()
    assert [(r.url, r.ord, r.keyword, r.quality_score, r.slot_type, r.intent_id) for r in rows] == [("u", 0, "Acme Mask", "high", "product_name", hashlib.sha1(b"brand|Acme Mask").hexdigest()[:16])]


def test_products_with_equal_ids_and_places_keep_their_own(spark):
    candidates = spark.createDataFrame([("u1", "i", 0, "brand", "a1"), ("u2", "i", 0, "brand", "b1")], "url string, intent_id string, ord int, category string, keyword string")
    texts = ['{"dropped_duplicates": [{"intent_text": "a9", "duplicate_of": "a1", "reason": "same"}], "surviving": [{"intent_id": "i", "quality_score": "high"}], "slot_gap_report": {"_total": 2.0, "x": "no"}}', '{"surviving": [{"intent_id": "i", "keep": false}]}']
    made = R.reports(spark.createDataFrame(list(zip(("u1", "u2"), texts, strict=True)), "url string, answer string"))
    got = R.surviving(candidates, R.answered_rows(made, ["url"]), ["url"]).collect()
    assert [(r.url, r.keyword, r.quality_score) for r in got] == [("u1", "a1", "high")]
    assert [(r.intent_text, r.duplicate_of, r.place) for r in R.pairs_of_duplicates(made, ["url"]).collect()] == [("a9", "a1", 1)]
    assert [(g.slot, g.missing) for r in made.collect() for g in r.gaps] == [("_total", 2)]


def plain(candidates, answers):
    """The first naming candidate of each answer, in a loop."""
    made = lambda c, k: hashlib.sha1(f"{c}|{k}".encode()).hexdigest()[:16]
    out = {}
    for url in {c[0] for c in candidates}:
        held = {}
        for _, i, _o, c, k in sorted((x for x in candidates if x[0] == url), key=lambda x: x[2]):
            held[i or made(c, k)] = (i, _o, c, k)
        for a in (a for a in answers.get(url, []) if a.get("keep", True)):
            k = a.get("keyword") or ""
            hit = a.get("intent_id") if a.get("intent_id") in held else made(a.get("category") or "", k) if k and made(a.get("category") or "", k) in held else None
            if hit is None and k:
                hit = next((i for i, x in held.items() if k in x[3] or x[3] in k), None)
            if hit is not None:
                out[url, held[hit][1]] = a.get("quality_score")
    return out


def test_survivors_equal_a_plain_loop(spark):
    r = random.Random(8)
    words = ["크림", "a", "ab", "abc", "bca", "레티놀", ""]
    text = lambda: " ".join(r.choices(words, k=r.randint(0, 3))).strip()
    candidates = [(f"u{u}", r.choice([f"i{o}", "i0", None]), o, r.choice("xy"), text()) for u in range(30) for o in range(6)]
    answers = {f"u{u}": [{"intent_id": r.choice(["i0", "i1", "i4", "zz", None]), "category": r.choice("xy"), "keyword": text(), "keep": r.random() < 0.8, "quality_score": r.choice(["high", "low"])} for _ in range(r.randint(0, 5))] for u in range(30)}
    asked = spark.createDataFrame([(u, json.dumps({"wrap": {"surviving": a}})) for u, a in answers.items()], "url string, answer string")
    got = R.surviving(spark.createDataFrame(candidates, "url string, intent_id string, ord int, category string, keyword string"), R.answered_rows(R.reports(asked), ["url"]), ["url"])
    assert {(x.url, x.ord): x.quality_score for x in got.collect()} == plain(candidates, answers)
