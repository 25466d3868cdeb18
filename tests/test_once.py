"""Texts that several rules or phrases read are computed once a row, not once a reader."""

import re

from pyspark.sql import functions as F

from keyloom.functions import keywords as K
from keyloom.functions import web
from keyloom.functions.arrays import any_in, texts
from keyloom.operators import bank, intents, interpret
from keyloom.plans import deep
from keyloom.scratch import written
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_searched_text_is_computed_once(spark):
    """Inside the lambda the text would be lowered for each of the words."""
    df = spark.createDataFrame([("Some TEXT", "a"), ("none", "b"), (None, "c")], "t string, k string")
    low = F.lower("t")
    out = df.select("k", K.has_any(low, ("text", "x")).alias("a"), any_in(low, texts(("text", "x"))).alias("b"), web.hits(low, ("text", "some", "q")).alias("c"))
    assert [tuple(r) for r in out.orderBy("k").collect()] == [("a", True, True, ["text", "some"]), ("b", False, False, []), ("c", None, None, [])]
    assert "lambdafunction(Contains(lower(" not in _plan(out)


def test_banks_share_their_parts(spark):
    """The name's first word is cut off once, and phrases that a category has are not signed again as padding."""
    packs = deep.product_packs(spark, SF)
    made = bank.with_bank(interpret.interpreted(packs)).select("bank")
    assert len(re.findall(r"regexp_replace\(name#", _plan(made))) <= 2
    assert len(_plan(made)) < 110_000


def test_padding_is_what_the_category_lacks(spark):
    """By the rule itself: unique padding, not low in information, whose signature none of the category's own phrases has, each signature once."""
    it = interpret.interpreted(deep.product_packs(spark, SF)).withColumnRenamed("category", "product_category").withColumn("weak_backfill_used", F.lit(False))
    it = it.withColumn("secondary", F.when(F.col("p_partkey") % 2 == 0, F.col("secondary")).otherwise(F.array(F.lit("수분 크림"), F.lit(None).cast("string"), F.lit("수분  크림")))).withColumn("short", F.when(F.col("p_partkey") % 3 == 0, F.lit("Short Name")).otherwise(F.col("short")))
    it = it.limit(60).localCheckpoint()
    made = {r["url"]: [(e["category"], e["keyword"], e["reason"].endswith("supplementation pool")) for e in r["bank"]] for r in bank.with_bank(it.withColumnRenamed("product_category", "category")).select("url", "bank").collect()}
    parts = bank._bank(False)
    source = bank._shared(it)
    from keyloom.functions.arrays import unique

    said = source.select("url", *[F.transform(unique(p[i]), lambda k: F.struct(k.alias("k"), bank.signature(k).alias("s"), K.low_information(k).alias("l"))).alias(f"{c}{i}") for c, p in parts.items() for i in (0, 4)])
    for r in said.collect():
        want = []
        for c in parts:
            taken, own = set(), []
            every = {x["s"] for x in r[f"{c}0"]}
            for x in r[f"{c}0"]:
                if x["s"] not in taken:
                    taken.add(x["s"])
                    own.append((c, x["k"], False))
            for x in r[f"{c}4"]:
                if not x["l"] and x["s"] not in every and x["s"] not in taken:
                    taken.add(x["s"])
                    own.append((c, x["k"], True))
            want += own
        assert made[r["url"]] == want


def test_a_block_is_read_once(spark):
    """White space of a block is collapsed once, not once for each word that is looked for; every kind of white space counts as before."""
    from keyloom import dims
    from keyloom.functions.arrays import SPACE, collapse, stripped
    from keyloom.operators import evidence

    every = spark.range(1, 0xD800).select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert every.where(F.col("c").rlike(f"^{SPACE}$") != F.col("c").rlike(f"^{dims.SPACE}$")).count() == 0
    said = ["", " ", "a", " a  b ", "a\tb", "\ta 　b\n", "가 나 다", "a b", " ", "a \t b\x1c"]
    df = spark.createDataFrame([(s,) for s in said] + [(None,)], "t string")
    old = F.trim(F.regexp_replace("t", dims.SPACE + "+", " "))
    assert df.where(~collapse(F.col("t")).eqNullSafe(old)).count() == 0
    assert df.where(~stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", f"^{dims.SPACE}+|{dims.SPACE}+$", ""))).count() == 0
    assert _plan(df.select(evidence.dropped_block(F.col("t"), F.lit("Night Cream"), F.lit("Acme")).alias("d"))).count("regexp_replace(") == 1


def test_rows_are_judged_once(spark):
    """The drop report reads the products once, and its soft count stands even where there is none."""
    import __spark_entry__ as entry

    report = entry.queries()["A14_drop_report"](spark, SF)
    assert _plan(report).count("Relation [") == 1
    assert ("low_information", "soft") in {(r["stage"], r["reason"]) for r in report.collect()}


def test_rules_are_compiled(spark):
    """No rule stands below a lambda that only drops the names of those that do not hold."""
    from keyloom.operators import rows
    from keyloom.plans import catalog

    plan = _plan(rows.with_issues(catalog.candidate_rows(spark, SF)).select("url", "hard_issues"))
    assert "filter(CASE" not in plan and "array_except(array(CASE" in plan


def test_short_forms_of_keyword_rules(spark):
    """Against the same rules over arrays of words."""
    from keyloom import dims

    said = ["", "a a", " a  a b", "aa a", "a aa", "크림 크림 추천", "추천 후기", "정보 크림 추천 검색", "크림 검색 추천", "크림추천 추천", "추천", "a\nA", "x x\n", "검색 검색 정리", None, "7 7", "Spec sheet", "크림 가이드 정보 후기 리뷰"]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    k = F.col("t")
    parts = F.filter(F.split(F.lower(k), r"\s+"), lambda x: x != "")
    twice = (F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(1)) == F.try_element_at(parts, F.lit(2)))
    low = K.has_any(F.lower(k), dims.LOW_INFORMATION) | K.boilerplate(k) | K.placeholder_unit(k) | F.coalesce(twice, F.lit(False))
    t = K.tokens(k, K.EVAL_TOKEN)
    s = K.strip_tail(K.strip_tail(t, dims.DUPLICATE_SUFFIXES), dims.LIGHT_FILLERS)
    signature = F.array_join(F.when(F.size(s) == 0, t).otherwise(s), " ")
    assert df.where(~low.eqNullSafe(K.low_information(k))).collect() == []
    assert df.where(~signature.eqNullSafe(K.semantic_signature(k))).collect() == []


def test_metrics_neither_double_nor_triple_rows(spark):
    """Against one aggregation over the rows of each platform; repeats, blanks, nulls and products with one platform included."""
    from keyloom.operators import rows

    said = ["크림 추천", "크림", " 크림 ", "Cream", "cream", "", None, "가 나 다 라 추천 후기 리뷰 비교", "중고"]
    made = [(f"u{i % 5}", said[i % 9], ("brand", "negative", "long_tail")[i % 3], (None, "", "확장소재", "제외키워드")[i % 4], (None, "negative", "broad")[i % 3] if i % 5 else None, "reason" * (i % 2), ["invalid_exact"] * (i % 2)) for i in range(180)] + [("one", None, "brand", "확장소재", None, None, [])]
    df = spark.createDataFrame(made, "url string, keyword string, category string, naver_match string, google_match string, reason string, hard_issues array<string>").withColumn("issues", F.col("hard_issues"))
    out = rows.url_metrics(df)
    assert "Expand" not in _plan(out)
    kw, positive, bad = F.col("keyword"), F.col("category") != "negative", F.size("hard_issues") > 0
    want = rows.by_platform(df).groupBy("url", "platform").agg(
        F.count_if(positive).alias("total"),
        F.count_if(positive & K.filler(kw)).alias("fillers"),
        F.sum(F.when(positive, K.naturalness(kw, F.lit(False))).otherwise(0)).alias("natural_sum"),
        F.count_distinct(F.when(positive, F.trim("keyword"))).alias("exact_distinct"),
        F.count_distinct(F.when(positive, K.semantic_signature(kw))).alias("semantic_distinct"),
        F.count_if(positive & (F.length("reason") > 5)).alias("reasoned"),
        F.count_if(positive & bad).alias("malformed"),
        F.count_if(~positive & F.col("label").isin("제외키워드", "negative") & bad).alias("invalid_negatives"),
    )
    assert sorted(out.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str) and want.count() > 8


def test_pages_are_not_sent_to_meet_themselves(spark):
    """A page and its cleaned form come from one row."""
    import __spark_entry__ as entry

    assert "Join" not in _plan(entry.queries()["H16_preprocessed"](spark, SF))


def test_visible_text_by_the_longer_patterns(spark):
    from keyloom import dims

    said = ["<p>a  b\t c</p>", "a <SCRIPT x>1</Script >2</sCript> b", "<style>\n</STYLE>\t x \t", "<NoScript>no</noscript>　y ", " a\r\n\r\n b\tc ", "<script>open", "", None]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    out = F.regexp_replace("t", "(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, f"(?is)<{tag}.*?>.*?</{tag}>", " ")
    out = web.unescape(F.regexp_replace(out, "<[^>]+>", "\n"))
    out = F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("\r"), F.lit("\n")), "[ \t]+", " "), "\n{2,}", "\n")
    out = F.regexp_replace(out, f"^{dims.SPACE}+|{dims.SPACE}+$", "")
    assert df.where(~out.eqNullSafe(web.visible_text(F.col("t")))).collect() == []
    assert "noscript" in _plan(df.select(web.visible_text(F.col("t")).alias("v"))) and "(?is)<" not in _plan(df.select(web.visible_text(F.col("t")).alias("v")))


def test_an_attribute_is_read_once(spark):
    """Once for each kind of quotes, not again for every test of what was found."""
    from keyloom.operators import images

    said = ['<img src="a">', "<img src='b &amp; c'>", "<img src=\"\" src='d'>", "<img alt='x'>", '<img src=" ">', None]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    out = df.select(images._attribute(F.col("t"), "src").alias("a"))
    assert [r["a"] for r in out.collect()] == ["a", "b & c", "d", None, None, None]
    assert _plan(out).count("(?is)(?:^|") == 2


def test_picks_take_signatures_from_the_bank(spark):
    """A candidate's signature is made with the bank, not again for the picks, and what is picked is what the loop over Python values picks."""
    banked = written(bank.with_bank(interpret.interpreted(deep.product_packs(spark, SF))))
    picked = bank.selected(banked, bank.category_plan(banked, F.lit(30)))
    again = banked.drop("signatures")
    assert "대한민국" not in _plan(picked) and "대한민국" in _plan(bank.selected(again, bank.category_plan(again, F.lit(30))))
    columns = ("url", "ord", "category", "keyword", "reason", "tier", "slot_type")
    assert sorted(map(str, picked.select(*columns).collect())) == sorted(map(str, bank.selected(again, bank.category_plan(again, F.lit(30))).select(*columns).collect()))


def test_generated_rows_are_judged_once(spark):
    """Scores, picks and negatives read one table of judged rows; none of them picks and judges again."""
    chosen, _ = intents.generate(deep.product_packs(spark, SF).where("p_partkey < 5"))
    assert "mapinarrow" not in _plan(chosen).lower()
    assert chosen.where("category = 'negative'").count() > 0 and chosen.where("category <> 'negative'").count() > 0
