"""Keyword rows: rendering, policy, selection, validation and quality metrics. Every relation carries its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import keywords as K
from keyloom.functions.arrays import collapse, named, none, rows_of
from keyloom.functions.tables import dealt, spread
from keyloom.operators import product
from keyloom.operators.interpret import terms_for

#: Platforms and the columns of their labels.
PLATFORM_LABELS = {"naver_sa": "naver_match", "google_sa": "google_match"}


def keyword_rows(products: DataFrame) -> DataFrame:
    """Rows of products (url, product_name, brand, type and any context columns): the templates explode from a literal array.

    Products are dealt by url first, so the rows of one lie together and later windows and groups by url need no exchange.
    """
    items = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("ord", "category", "pattern", "reason", "evidence_tier", "quality_score"), row, ("int", *["string"] * 5), strict=True)]) for row in dims.TEMPLATES])
    out = dealt(products, "url").select("*", F.explode(items).alias("x")).select(*products.columns, "x.*")
    filled = F.col("pattern")
    for mark, column in (("{b}", "brand"), ("{n}", "product_name"), ("{t}", "type")):
        filled = F.replace(filled, F.lit(mark), F.col(column))
    return out.withColumn("keyword", filled).drop("pattern").withColumn("naver_match", K.naver_label(F.col("category"))).withColumn("google_match", K.google_label(F.col("category")))


def _context(rows: DataFrame, name: str, default: Column) -> Column:
    """A column of the product's context, or what holds where rows carry none."""
    return F.coalesce(F.col(name), default) if name in rows.columns else default


def allowed_negative(keyword: Column, product_name: Column, types: Column) -> Column:
    """Whether a negative is a term of the taxonomy for one of the types, alone or after the product's name."""
    terms = terms_for(types, "negative_seed")
    return F.array_contains(terms, keyword) | (keyword.startswith(F.concat(product_name, F.lit(" "))) & F.array_contains(terms, F.trim(F.substring(keyword, F.length(product_name) + 1, F.length(keyword)))))


def with_issues(rows: DataFrame) -> DataFrame:
    """Rows with their ordered policy ``issues`` and the ``hard_issues`` among them.

    Context columns, all optional: page_class, types, competitors, category_terms, identity (names of the product itself).
    """
    # keyword, its lower case and tokens are columns of their own first: each is used by many rules and made once
    out = rows.withColumn("kw_", collapse(F.col("keyword"))).withColumn("low_", F.lower("kw_")).withColumn("tokens_", F.regexp_extract_all("low_", F.lit(f"({K.POLICY_TOKEN})"), F.lit(1)))
    kw, low, t = F.col("kw_"), F.col("low_"), F.col("tokens_")
    brand, name = F.coalesce("brand", F.lit("")), F.coalesce("product_name", F.lit("product"))
    positive = F.col("category") != dims.NEGATIVE
    types = _context(rows, "types", F.array(F.lit("general")))
    exact = F.col("naver_match").isin("완전일치", "exact") | F.col("google_match").isin("완전일치", "exact")
    rivals = product.valid_competitor(kw, _context(rows, "competitors", none()), _context(rows, "identity", F.array(name, brand)), _context(rows, "category_terms", none()), types)
    rules = [
        ("repeated_phrase", K.repeated_tokens(t)),
        ("placeholder_unit", K.placeholder_unit(kw, t)),
        ("doc_boilerplate", K.boilerplate(kw, low) & (_context(rows, "page_class", F.lit("commerce_pdp")) == "commerce_pdp")),
        ("invalid_exact", exact & K.invalid_exact(kw, F.col("category"), name, K.short_name(name, brand), brand, t, low)),
        ("invalid_negative", ~positive & ~allowed_negative(kw, name, types)),
        ("invalid_competitor", (F.col("category") == "competitor_comparison") & ~rivals),
        ("placeholder_product_term", positive & K.token_in(t, dims.PLACEHOLDER_PRODUCTS)),
        ("domain_mismatch_phrase", positive & product.domain_mismatch(kw, types)),
        ("low_information", positive & K.low_information(kw, t, low)),
    ]
    issues = F.when(kw == "", F.array(F.lit("empty_keyword"))).otherwise(named(rules))
    out = out.withColumn("issues", issues).drop("kw_", "low_", "tokens_")
    return out.withColumn("hard_issues", F.array_intersect("issues", F.array(*[F.lit(n) for n in dims.HARD_ISSUES])))


def hard_rules(rows: DataFrame) -> DataFrame:
    """Rows without banned terms and with labels that their platforms know."""
    legal = lambda c, labels: F.coalesce(F.col(c), F.lit("")).isin("", *labels)
    return rows.where(banned_term().isNull() & legal("naver_match", dims.NAVER_LABELS) & legal("google_match", dims.GOOGLE_LABELS))


def banned_term() -> Column:
    """The first banned term in keyword and reason, in the order of the terms; null if none."""
    text = F.concat_ws(" ", F.nullif("keyword", F.lit("")), F.nullif("reason", F.lit("")))
    return F.try_element_at(F.filter(K.words(dims.BANNED_TERMS), lambda t: F.contains(text, t)), F.lit(1))


def by_platform(rows: DataFrame) -> DataFrame:
    """Rows once for each platform whose label they carry."""
    sides = F.array(F.struct(F.lit("naver_sa").alias("platform"), F.col("naver_match").alias("label")), F.struct(F.lit("google_sa").alias("platform"), F.col("google_match").alias("label")))
    return rows.withColumn("side", F.explode(F.filter(sides, lambda s: F.coalesce(s["label"], F.lit("")) != ""))).select("*", "side.platform", "side.label").drop("side")


def selection_scores(rows: DataFrame) -> DataFrame:
    """Score in ten-thousandths: quality base, evidence, soft policy, surface (a column ``surface``, if there is one), crowding in the family of a category; and the ordered ``penalties``."""
    rows = (rows if "issues" in rows.columns else with_issues(rows)).where(F.col("category") != dims.NEGATIVE).withColumn("family", K.family_key(F.col("keyword")))
    size = F.count("*").over(Window.partitionBy("url", "category", "family"))
    base = F.lit(7200)
    for name, value in dims.QUALITY_BASE.items():
        base = F.when(F.lower(F.trim("quality_score")) == name, round(value * 10000)).otherwise(base)
    tier = F.lower(F.trim(F.coalesce("evidence_tier", F.lit(""))))
    evidence = F.when(tier == "direct", 1200).when(tier == "weak", -1000).when(tier != "", 400).otherwise(0)
    low = F.array_contains("issues", "low_information")
    code = F.col("surface") if "surface" in rows.columns else F.lit(None).cast("string")
    worn = F.lit(0)
    for name, value in dims.SURFACE_PENALTIES.items():
        worn = F.when(code == name, round(value * 10000)).otherwise(worn)
    rows = rows.withColumn("family_size", F.when(F.col("family") == "", 0).otherwise(size))
    crowd = F.when(F.col("family_size") > 1, F.least(F.lit(1600), (F.col("family_size") - 1) * 800)).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(10000), base + evidence - F.when(low, 1200).otherwise(0) - worn - crowd)).cast("int")
    signs = F.array_compact(F.array(F.when(tier != "", F.concat(F.lit("evidence_"), tier)), F.when(low, "policy_low_information"), F.when(worn > 0, code), F.when(F.col("family_size") > 1, "duplicate_family_crowding")))
    return rows.withColumns({"score": score, "penalties": signs})


def select_rows(scored: DataFrame, target: int, mode: str = "both") -> DataFrame:
    """The best row of each category in the order of categories, then the best of the rest, as long as no platform of a row has ``target`` rows.

    What a row takes from a platform decides what later ones may take, so a product's ordered rows are folded: one exchange by url.
    """
    platforms = {"naver_sa": (True, False), "google_sa": (False, True), "both": (True, True)}[mode]
    pos = F.create_map(*[x for i, c in enumerate(dims.CATEGORY_TARGETS) for x in (F.lit(c), F.lit(i))])
    label = lambda c, on: (F.coalesce(F.col(c), F.lit("")) != "") if on else F.lit(False)
    key = F.struct((-F.col("score")).alias("s"), F.when(F.col("evidence_tier") == "direct", 0).otherwise(1).alias("d"), F.col("ord").alias("ord"))
    item = F.struct(key.alias("key"), F.coalesce(pos[F.col("category")], F.lit(99)).alias("pos"), F.struct("category", "keyword", F.coalesce("naver_match", F.lit("")).alias("naver_match"), F.coalesce("google_match", F.lit("")).alias("google_match")).alias("row"), label("naver_match", platforms[0]).alias("n"), label("google_match", platforms[1]).alias("g"))
    listed = scored.groupBy("url").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    fits = lambda st, x: (x["n"] | x["g"]) & (~x["n"] | (st["n"] < target)) & (~x["g"] | (st["g"] < target))
    add = lambda st, x, place: F.struct((st["n"] + x["n"].cast("int")).alias("n"), (st["g"] + x["g"].cast("int")).alias("g"), place.alias("pos"), F.concat(st["out"], F.array(x["key"]["ord"])).alias("out"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("g"), F.lit(-1).alias("pos"), F.array().cast(f"array<{scored.schema['ord'].dataType.simpleString()}>").alias("out"))
    by_category = F.transform(F.sort_array(F.transform("rows", lambda x: F.struct(x["pos"].alias("p"), x.alias("x")))), lambda y: y["x"])
    lead = F.aggregate(F.filter(by_category, lambda x: x["pos"] < 99), start, lambda st, x: F.when((x["pos"] != st["pos"]) & fits(st, x), add(st, x, x["pos"])).otherwise(st))
    listed = listed.withColumn("lead", lead).withColumn("taken", F.transform(F.filter("rows", lambda x: F.array_contains(F.col("lead.out"), x["key"]["ord"])), lambda x: x["row"]))
    rest = F.filter("rows", lambda x: ~F.array_contains(F.col("taken"), x["row"]))
    done = F.aggregate(rest, F.col("lead"), lambda st, x: F.when(fits(st, x), add(st, x, F.lit(99))).otherwise(st), lambda st: st["out"])
    chosen = listed.select("url", F.posexplode(done).alias("place", "ord"))
    return scored.join(spread(chosen.withColumn("place", F.col("place") + 1)), ["url", "ord"])


def selection_summary(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """Selected and dropped rows per product and category, and the product's one cutline (the least selected score).

    A row counts as dropped if no selected row of the product has its category, keyword and labels.
    """
    names = ["url", "category", "keyword", "naver_match", "google_match"]
    picked = chosen.select("url", "ord", F.lit(True).alias("hit"))
    marked = scored.select(*names, "ord", "score").join(spread(picked), ["url", "ord"], "left")
    same = F.max(F.coalesce("hit", F.lit(False))).over(Window.partitionBy(*names))
    marked = marked.withColumn("same", same).withColumn("cutline", F.min(F.when(F.col("hit"), F.col("score"))).over(Window.partitionBy("url")))
    return marked.groupBy("url", "category").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("selected"), F.count_if(~F.col("same")).alias("dropped"), F.first("cutline").alias("cutline"))


def validation(rows: DataFrame, least: int = 100) -> DataFrame:
    """Status of each (url, platform): label, banned term, policy, count, negatives, weak ratio; the first failure names it."""
    rows = by_platform(rows if "issues" in rows.columns else with_issues(rows)).withColumn("banned", banned_term())
    naver = F.col("platform") == "naver_sa"
    ok_labels = F.when(naver, F.col("label").isin(*dims.NAVER_LABELS)).otherwise(F.col("label").isin(*dims.GOOGLE_LABELS))
    positive = F.col("category") != dims.NEGATIVE
    negative = ~positive & (F.col("label") == F.when(naver, "제외키워드").otherwise("negative"))
    first = lambda value, when: F.min(F.when(when, F.struct("ord", value.alias("v"))))["v"]
    judged = positive | negative
    agg = rows.groupBy("url", "platform").agg(
        first(F.col("label"), ~ok_labels).alias("bad_label"),
        first(F.col("banned"), judged & F.col("banned").isNotNull()).alias("banned"),
        first(F.concat_ws(":", "category", "keyword", F.array_join("hard_issues", ", ")), judged & (F.size("hard_issues") > 0)).alias("violation"),
        F.count_if(judged & (F.size("hard_issues") > 0)).alias("violations"),
        F.count_if(positive).alias("positives"),
        F.count_if(negative).alias("negatives"),
        F.count_if(positive & (F.col("evidence_tier") == "weak")).alias("weak"),
        *[F.count_if(positive & (F.col("category") == c)).alias("n_" + c) for c in dims.CATEGORY_TARGETS],
    )
    lit, platform = F.lit, F.col("platform")
    rules = [
        (F.col("bad_label").isNotNull(), "generation_rule_violation", F.concat(lit("invalid "), platform, lit(" match label: "), "bad_label")),
        (F.col("banned").isNotNull(), "generation_rule_violation", F.concat(lit("banned term emitted: "), "banned")),
        (F.col("violation").isNotNull(), "generation_rule_violation", F.col("violation")),
        (F.col("positives") < least, "generation_count_shortfall", F.concat(platform, lit(f" positive rows below {least}"))),
        (F.col("negatives") == 0, "generation_rule_violation", F.concat(platform, lit(" missing negative rows"))),
        (F.col("weak") * 5 > F.col("positives"), "generation_rule_violation", F.concat(platform, lit(" weak-tier ratio exceeded 20%"))),
    ]
    code, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, name, text in reversed(rules):
        code, detail = F.when(holds, name).otherwise(code), F.when(holds, text).otherwise(detail)
    missing = F.array_compact(F.array(*[F.when(F.col("n_" + c) == 0, F.lit(c)) for c in dims.CATEGORY_TARGETS]))
    out = agg.withColumns({"failure_code": code, "failure_detail": detail, "missing_categories": missing, "weak_ratio": F.when(F.col("positives") > 0, F.col("weak") / F.col("positives")).otherwise(0.0)})
    return out.withColumn("status", F.when(F.col("failure_code").isNull(), "COMPLETED").otherwise("FAILED_GENERATION")).drop(*["n_" + c for c in dims.CATEGORY_TARGETS])


def validation_report(validated: DataFrame) -> DataFrame:
    """One report per product: completed, or the failure of its first platform that fails."""
    turn = F.when(F.col("platform") == "naver_sa", 0).otherwise(1)
    worst = F.min(F.when(F.col("failure_code").isNotNull(), F.struct(turn.alias("t"), "failure_code", "failure_detail"))).alias("w")
    out = validated.groupBy("url").agg(worst, F.min("positives").alias("least_positives"))
    return out.select("url", F.when(F.col("w").isNull(), "COMPLETED").otherwise("FAILED_GENERATION").alias("status"), "w.failure_code", "w.failure_detail", "least_positives")


def deviation(prefix: str = "n_") -> Column:
    """Mean distance of category shares from the ideal ones, absent categories included."""
    total = F.lit(0.0)
    for c, share in dims.IDEAL_SHARES.items():
        total = total + F.abs(F.col(prefix + c) / F.greatest(F.col("total"), F.lit(1)) - F.lit(share))
    return total / len(dims.IDEAL_SHARES)


def url_metrics(rows: DataFrame) -> DataFrame:
    """Quality metrics of each (url, platform); ratios are unrounded.

    Rows are neither doubled for the platforms nor tripled for the distinct counts: sums of both platforms stand side by side,
    first for each keyword and signature, then for each signature, then for the product. All three lie in one partitioning by url.
    """
    kw, t = F.col("keyword"), F.col("tokens_")
    rows = (rows if "issues" in rows.columns else with_issues(rows)).withColumn("tokens_", K.tokens(kw, K.EVAL_TOKEN))
    support = _context(rows, "page_class", F.lit("")).isin(*dims.SUPPORT_CLASSES)
    rows = rows.withColumns({"filler_": K.filler(kw, t), "signature_": K.semantic_signature(kw, t)}).withColumn("natural_", K.naturalness(kw, support, t, F.col("filler_")))
    positive = F.col("category") != dims.NEGATIVE
    exact, signature = F.when(positive, F.trim("keyword")).alias("exact_"), F.when(positive, F.col("signature_")).alias("said_")
    bad = F.size("hard_issues") > 0
    rules = {
        "rows": F.lit(True),
        "total": positive,
        "fillers": positive & F.col("filler_"),
        "reasoned": positive & (F.length(F.trim("reason")) > 5),
        "malformed": positive & bad,
        **{"n_" + c: F.col("category") == c for c in dims.IDEAL_SHARES},
    }
    first, sums = [], []
    for p, label in PLATFORM_LABELS.items():
        here = F.coalesce(F.col(label), F.lit("")) != ""
        negative = ~positive & F.col(label).isin("제외키워드", "negative")
        first += [F.count_if(here & c).alias(f"{p}_{n}") for n, c in (rules | {"invalid_negatives": negative & bad}).items()]
        first += [F.sum(F.when(here, F.when(positive, F.col("natural_")).otherwise(0))).alias(f"{p}_natural_sum")]
        sums += [F.sum(f"{p}_{n}").alias(f"{p}_{n}") for n in (*rules, "invalid_negatives", "natural_sum")]
    count = lambda of, name: [F.count_if(F.col(of).isNotNull() & (F.col(f"{p}_total") > 0)).alias(f"{p}_{name}") for p in PLATFORM_LABELS]
    of = lambda name: [F.sum(f"{p}_{name}").alias(f"{p}_{name}") for p in PLATFORM_LABELS]
    out = rows.groupBy("url", exact, signature).agg(*first)
    out = out.groupBy("url", "said_").agg(*sums, *count("exact_", "exact_distinct"))
    out = out.groupBy("url").agg(*sums, *of("exact_distinct"), *count("said_", "semantic_distinct"))
    names = (*rules, "invalid_negatives", "natural_sum", "exact_distinct", "semantic_distinct")
    sides = F.array(*[F.struct(F.lit(p).alias("platform"), *[F.col(f"{p}_{n}").alias(n) for n in names]) for p in PLATFORM_LABELS])
    out = rows_of(out, sides, "url").select("url", "x.*").where("rows > 0").drop("rows").withColumn("deviation", F.when(F.col("total") > 0, deviation()).otherwise(1.0))
    t = F.greatest(F.col("total"), F.lit(1))
    points = F.col("natural_sum") / (t * 100) * 30 + F.greatest(F.lit(0.0), 10 - F.col("deviation") * 100) + F.col("semantic_distinct") / t * 10 + F.col("reasoned") / t * 10
    costs = F.col("fillers") / t * 60 + (F.col("malformed") * 3 + F.col("invalid_negatives")) / 2
    some = F.col("total") > 0
    reasons = [
        ("insufficient_positive_rows", F.col("total") < 100),
        ("high_filler_ratio", F.col("fillers") * 100 >= t * 15),
        ("low_naturalness", F.col("natural_sum") < t * 70),
        ("low_semantic_uniqueness", F.col("semantic_distinct") * 100 < t * 95),
        ("malformed_positive_keywords", F.col("malformed") > 0),
        ("invalid_negative_keywords", F.col("invalid_negatives") > 0),
    ]
    out = out.withColumn("auto_score", F.when(some, F.least(F.lit(100.0), F.greatest(F.lit(0.0), points - costs))).otherwise(0.0))
    failures = F.when(some, F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in reasons])).otherwise("no_positive_rows")
    return out.withColumn("failures", failures).drop(*["n_" + c for c in dims.IDEAL_SHARES])


def duplicate_families(rows: DataFrame, most: int = 10) -> DataFrame:
    """Signatures that several positive rows of a product share: the ``most`` largest, with up to five keywords in order."""
    named = rows.where(F.col("category") != dims.NEGATIVE).withColumn("signature", K.semantic_signature(F.col("keyword")))
    sizes = named.groupBy("url", "signature").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("ord", "keyword"))), 1, 5).alias("k")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("n"), "signature"))
    return sizes.withColumn("place", place).where(F.col("place") <= most).select("url", "signature", "n", F.array_join(F.col("k.keyword"), "|").alias("keywords"))


def export_rows(rows: DataFrame) -> DataFrame:
    return (rows if "quality_warning" in rows.columns else rows.withColumn("quality_warning", F.lit(False))).select(*dims.EXPORT_COLUMNS)
