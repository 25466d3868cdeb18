"""Targets of supplement rounds against a plain loop, and the rounds themselves with a fake model."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.operators import slots, supplement

ROWS = "url string, ord int, category string, slot_type string, keyword string, naver_match string, google_match string"
PLAN = "url string, place int, category string, slot_type string, target int, required boolean"
CATEGORIES = [*dims.CATEGORY_TARGETS]


def plain(urls, rows, plan, most, mode):
    platforms = {"naver_sa": [5], "google_sa": [6], "both": [5, 6]}[mode]
    out = {}
    for url in urls:
        own, slots_ = [r for r in rows if r[0] == url], sorted((p for p in plan if p[0] == url), key=lambda p: p[1])
        usual = lambda c: dims.DEFAULT_SLOTS.get(c, "surface")
        lacking = {c for c in [*CATEGORIES, dims.NEGATIVE] for p in platforms if not any(r[2] == c and r[p] for r in own)}
        gaps = {(p[2], p[3]) for p in slots_ for q in platforms if p[4] > sum((r[2], (r[3] or "").strip() or usual(r[2])) == (p[2], p[3]) and bool(r[q]) for r in own)}
        t = {}
        for c in lacking:
            mine = [p for p in slots_ if p[2] == c]
            best = next((p for p in mine if p[5]), mine[0] if mine else None)
            t[c, best[3] if best else usual(c)] = 1
        for key in gaps:
            if key[0] not in lacking - {dims.NEGATIVE}:
                t.setdefault(key, 1)
        left = max(0, max(max(0, most - sum(r[2] != dims.NEGATIVE and bool(r[q]) for r in own)) for q in platforms) - sum(v for k, v in t.items() if k[0] != dims.NEGATIVE))
        if left:
            heavy = [p for p in slots_ if p[5] and p[2] != dims.NEGATIVE]
            total, given = sum(max(1, p[4]) for p in heavy), 0
            for p in heavy:
                extra = max(1, int(left * max(1, p[4]) / max(1, total)))
                t[p[2], p[3]] = t.get((p[2], p[3]), 0) + extra
                given += extra
            over = given - left
            for p in reversed(heavy):
                if over > 0 and t[p[2], p[3]] > 1:
                    less = min(over, t[p[2], p[3]] - 1)
                    t[p[2], p[3]] -= less
                    over -= less
        out |= {(url, *k): v for k, v in t.items()}
    return out


@pytest.mark.parametrize("mode", ["both", "naver_sa"])
def test_targets_equal_a_plain_loop(spark, mode):
    r = random.Random(11)
    urls = [f"u{i}" for i in range(12)]
    plan, rows = [], []
    for u in urls:
        place = 0
        for c in [*r.sample(CATEGORIES, r.randint(3, 9)), dims.NEGATIVE]:
            for k, s in enumerate(dims.SLOT_ORDER[c][: r.randint(1, 3)]):
                plan.append((u, place, c, s, r.randint(1, 9), k == 0 and r.random() < 0.9))
                place += 1
        for o in range(r.choice([0, 5, 20, 45])):
            c = r.choice([*CATEGORIES, dims.NEGATIVE])
            rows.append((u, o, c, r.choice([*dims.SLOT_ORDER[c], "", None]), f"k{o}", r.choice(["", "x"]), r.choice(["", "x"])))
    got = supplement.targets(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rows, ROWS), spark.createDataFrame(plan, PLAN), 40, mode).collect()
    want = plain(urls, rows, plan, 40, mode)
    assert {(x.url, x.category, x.slot_type): x.target for x in got} == want and len(got) == len(want)
    sums = defaultdict(int)
    for (u, *_), v in want.items():
        sums[u] += v
    assert all(x.total == sums[x.url] for x in got)


def test_rounds_close_gaps_or_say_why_not(spark):
    urls = ["good", "half", "mute", "full"]
    plan = [(u, i, c, dims.DEFAULT_SLOTS[c], 1, True) for u in urls for i, c in enumerate([*CATEGORIES, dims.NEGATIVE])]
    rows = [("full", i, c, dims.DEFAULT_SLOTS[c], f"word{i} {'abcdefghij'[i]}", "x", "x") for i, c in enumerate([*CATEGORIES, dims.NEGATIVE])] + [("good", 0, "brand", "product_name", "only one", "x", "x")]
    asked = []

    def ask(number, wanted, have):
        """Gives all that is wanted to one product, half of it to another (a category a round), and always the same to the third."""
        asked.append({r.url for r in wanted.select("url").distinct().collect()})
        each = wanted.where("url = 'good' or (url = 'half' and category in ('brand', 'negative'))").select("url", "category", "slot_type", F.explode(F.sequence(F.lit(1), "target")).alias("i"))
        letters = F.concat_ws(" ", "category", F.format_string("n%d", F.col("i") + 100 * number))
        same = spark.createDataFrame([("full", 5, "brand", "product_name", "not asked for", "x", "x")], ROWS)
        return each.select("url", F.col("i").cast("int").alias("ord"), "category", "slot_type", letters.alias("keyword"), F.lit("x").alias("naver_match"), F.lit("x").alias("google_match")).unionByName(same)

    products = spark.createDataFrame([(u,) for u in urls], "url string")
    have, report = supplement.supplemented(products, spark.createDataFrame(rows, ROWS), spark.createDataFrame(plan, PLAN), ask, most=9, rounds=3)
    got = {r.url: r for r in report.collect()}
    assert {u: (r.reason, r.missing == 0) for u, r in got.items()} == {"good": ("closed", True), "half": ("nothing new", False) if got["half"].rounds > 1 else ("limit", False), "mute": ("nothing new", False), "full": ("closed", True)}
    assert asked[0] == {"good", "half", "mute"} and all("mute" not in a and "full" not in a for a in asked[1:])
    kept = have.collect()
    assert not any(r.keyword == "not asked for" for r in kept) and len({(r.url, r.category, r.keyword) for r in kept}) == len(kept)
    assert got["full"].rounds == 0 and got["full"].added == 0 and got["good"].added >= 9
    none, empty = supplement.supplemented(products.limit(0), spark.createDataFrame([], ROWS), spark.createDataFrame([], PLAN), ask)
    assert none.count() == 0 and empty.count() == 0


def test_rounds_stop_at_the_limit(spark):
    plan = [("u", 0, "brand", "product_name", 5, True)]

    def ask(number, wanted, have):
        return spark.createDataFrame([("u", 0, "brand", "product_name", f"fresh {'xyz'[number]} {'pqr'[number]}word", "x", "x")], ROWS)

    _, report = supplement.supplemented(spark.createDataFrame([("u",)], "url string"), spark.createDataFrame([], ROWS), spark.createDataFrame(plan, PLAN), ask, most=50, rounds=2)
    (r,) = report.collect()
    assert (r.rounds, r.added, r.reason) == (2, 2, "limit") and r.missing > 0


def test_default_slots_are_known():
    assert set(dims.DEFAULT_SLOTS) >= {*CATEGORIES} and callable(slots.default_slot)


def test_generation_asks_a_model_for_what_is_lacking(spark):
    from keyloom.operators import intents
    from keyloom.plans import deep
    from tests.conftest import SF

    packs = deep.product_packs(spark, SF).limit(1)

    def ask(number, wanted, have):
        words = F.concat(F.lit("레티놀 크림 "), F.lit(" 가나"[number]), F.lit(" "), "category")
        return wanted.select("url", "category", "slot_type", words.alias("keyword"), F.lit("asked of a model").alias("reason"), F.lit("direct").alias("evidence_tier"))

    chosen, report = intents.generate(packs, "naver_sa", 60, ask=ask)
    (r,) = report.collect()
    assert (r.rounds, r.reason) == (2, "limit") and r.added > 0 and r.missing > 0
    rows = chosen.collect()
    assert any(x.ord >= 1_000_000 for x in rows) and all(x.google_match == "" for x in rows)
