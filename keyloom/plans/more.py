"""More registered queries: images, product identity, cache components, reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import keywords as K
from keyloom.functions import web
from keyloom.functions.arrays import rows_of
from keyloom.functions.tables import dealt, spread
from keyloom.operators import facts, images, pages, product, rows, slots
from keyloom.plans import sql as S
from keyloom.plans.catalog import _CHOSEN, _t, candidate_rows, query

_HTML = "'<p>x</p><img src=\"/detail/' || p_partkey || '.webp?v=1\" alt=\"' || p_type || ' &amp; co\" width=\"' || (p_size * 30) || '\" height=\"700\"><IMG data-src=\"data:abc\" alt=\"none\"><img alt=\"again\" src=''/detail/' || p_partkey || '.webp?v=1''><img data-src=\"img/' || p_brand || '.jpg\">'"


def _image_pages(spark, d):
    html = F.expr(_HTML.replace("''/detail", "\\'/detail").replace("?v=1''>", "?v=1\\'>"))
    return dealt(_t(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.lit("https://shop.example.com/a/b.html?x=1").alias("url"), html.alias("html"))


@query("H04_image_candidates", "SELECT p_partkey AS page_id, 0 AS dom_index, 'https://shop.example.com/detail/' || p_partkey || '.webp?v=1' AS src, p_type || ' & co' AS alt, 'src' AS attribute, (p_size * 30)::INTEGER AS width, 700::INTEGER AS height, true AS detail_hint FROM part UNION ALL SELECT p_partkey, 3, 'https://shop.example.com/a/img/' || p_brand || '.jpg', '', 'data-src', NULL, NULL, true FROM part")
def h04(spark, d):
    return images.image_candidates(_image_pages(spark, d))


_CAND_SQL = "WITH c AS (SELECT p_partkey AS page_id, 0 AS dom_index, 'https://x.example.com/' || lower(p_brand) || '/' || replace(p_name, ' ', '-') || CASE p_size % 4 WHEN 0 THEN '.webp' WHEN 1 THEN '.svg' WHEN 2 THEN '_detail.jpg' ELSE '-table.png' END AS src, p_name || CASE p_size % 5 WHEN 0 THEN ' front label' WHEN 1 THEN ' logo' ELSE '' END AS alt, CASE WHEN p_size % 2 = 0 THEN 'src' ELSE 'data-src' END AS attribute, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 40 END AS width, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * p_size * 3 END AS height, p_size % 2 = 1 AS detail_hint FROM part)"


def _candidates(spark, d):
    size = F.col("p_size")
    src = F.concat(F.lit("https://x.example.com/"), F.lower("p_brand"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.when(size % 4 == 0, ".webp").when(size % 4 == 1, ".svg").when(size % 4 == 2, "_detail.jpg").otherwise("-table.png"))
    alt = F.concat("p_name", F.when(size % 5 == 0, " front label").when(size % 5 == 1, " logo").otherwise(""))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("dom_index"), src.alias("src"), alt.alias("alt"), F.when(size % 2 == 0, "src").otherwise("data-src").alias("attribute"), F.when(size % 7 != 0, size * 40).alias("width"), F.when(size % 7 != 0, size * size * 3).alias("height"), (size % 2 == 1).alias("detail_hint"))


_BOTH = "lower(src) || ' ' || lower(alt)"
_TYPE_SQL = f"CASE WHEN width > 0 AND height > 0 AND height >= greatest(width * 2.2, 1200) THEN 'long_detail_banner' WHEN {S.has_any(_BOTH, dims.TABLE_IMAGES)} THEN 'table_like_image' WHEN {S.has_any(_BOTH, dims.FRONT_LABELS)} THEN 'front_label_closeup' WHEN width > 0 AND height > 0 AND detail_hint AND greatest(width, height) <= 1100 THEN 'front_label_closeup' ELSE 'general_detail_image' END"


@query("O03_candidate_types", f"{_CAND_SQL} SELECT page_id, {_TYPE_SQL} AS candidate_type FROM c")
def o03(spark, d):
    return _candidates(spark, d).select("page_id", images.candidate_type().alias("candidate_type"))


@query("O02_reject_reasons", f"{_CAND_SQL}, t AS (SELECT *, {_TYPE_SQL} AS k FROM c) SELECT page_id, CASE WHEN {S.has_any(_BOTH, dims.REJECT_IMAGES)} THEN 'decorative_asset' WHEN {S.has_any(_BOTH, dims.REJECT_TEMPLATES)} THEN 'templated_asset_url' WHEN suffix(lower(src), '.svg') OR suffix(lower(src), '.gif') OR suffix(lower(src), '.ico') THEN 'non_ocr_image_format' WHEN {S.has_any(_BOTH, dims.REJECT_HOSTS)} THEN 'remote_ui_asset' WHEN {S.has_any('lower(src)', dims.REJECT_PATHS)} AND k <> 'table_like_image' AND NOT detail_hint THEN 'decorative_path_asset' WHEN width < 300 OR height < 300 THEN 'below_min_dimensions' END AS rejected FROM t")
def o02(spark, d):
    return _candidates(spark, d).withColumn("candidate_type", images.candidate_type()).select("page_id", images.reject_reason().alias("rejected"))


_REJECTED = f"{S.has_any(_BOTH, dims.REJECT_IMAGES)} OR {S.has_any(_BOTH, dims.REJECT_TEMPLATES)} OR suffix(lower(src), '.svg') OR {S.has_any(_BOTH, dims.REJECT_HOSTS)} OR ({S.has_any('lower(src)', dims.REJECT_PATHS)} AND k <> 'table_like_image' AND NOT detail_hint) OR coalesce(width < 300 OR height < 300, false)"
_POINTS = f"15 + CASE k WHEN 'table_like_image' THEN 55 WHEN 'long_detail_banner' THEN 35 WHEN 'front_label_closeup' THEN 25 ELSE 0 END + CASE WHEN {S.has_any(_BOTH, dims.SPEC_TOKENS)} THEN 20 ELSE 0 END + CASE WHEN {S.has_any(_BOTH, dims.FRONT_LABELS)} THEN 12 ELSE 0 END + CASE WHEN width IS NOT NULL AND least(width, height) >= 900 THEN 8 ELSE 0 END"
_SCORE = f"CASE WHEN width > 0 AND height > 0 THEN CASE WHEN width * height >= 90000 THEN least(width * height / 1000000::DOUBLE, 1.5::DOUBLE) ELSE 0::DOUBLE END ELSE 0.25::DOUBLE END + CASE WHEN {S.has_any(_BOTH, dims.PRIORITY_IMAGES)} THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN detail_hint OR {S.has_any('lower(src)', dims.DETAIL_PATHS)} THEN 1.4::DOUBLE ELSE 0 END + CASE WHEN attribute <> 'src' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN suffix(lower(src), '.webp') THEN 0.15::DOUBLE ELSE 0 END + 0::DOUBLE + 0.15::DOUBLE + density / 100::DOUBLE * 0.45::DOUBLE + CASE k WHEN 'long_detail_banner' THEN 0.45::DOUBLE WHEN 'table_like_image' THEN 0.55::DOUBLE WHEN 'front_label_closeup' THEN 0.25::DOUBLE ELSE 0 END"


@query("O04_ranked_images", f"{_CAND_SQL}, t AS (SELECT *, {_TYPE_SQL} AS k FROM c), g AS (SELECT *, least(100, {_POINTS}) AS density FROM t WHERE NOT ({_REJECTED})) SELECT page_id, src, k AS candidate_type, density, round_even({_SCORE}, 4) AS score, 1 AS rank FROM g")
def o04(spark, d):
    return images.ranked_images(_candidates(spark, d)).select("page_id", "src", "candidate_type", "density", "score", "rank")


@query("O01_trigger_reasons", f"{S.classed()} SELECT page_id, array_to_string(list_filter([CASE WHEN chars < 1500 THEN 'thin_visible_text' END, CASE WHEN page_class = 'image_heavy_commerce_pdp' THEN 'image_heavy_page' END], lambda x: x IS NOT NULL), '|') AS reasons FROM classed")
def o01(spark, d):
    p = pages.classified(_t(spark, d, "pages"))
    return p.select("page_id", F.array_join(images.trigger_reasons(F.col("chars"), F.lit(1.0), F.col("page_class"), F.lit(False), F.lit(False)), "|").alias("reasons"))


# -- product identity


@query("I05_product_types", "WITH h AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {S.has_any('lower(text)', v)} THEN {S.q(t)} END" for t, v in dims.PRODUCT_TYPES.items()) + "], lambda x: x IS NOT NULL) AS t FROM documents) SELECT doc_id, CASE WHEN len(t) = 0 THEN 'general' ELSE array_to_string(t, '|') END AS types FROM h")
def i05(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(product.product_types(F.col("text")), "|").alias("types"))


_KIND_ROWS = ", ".join(f"({i}, {S.lst(v) if v else '[]::VARCHAR[]'})" for i, v in enumerate(dims.COMPETITORS.values()))


@query("I07_competitor_terms", f"WITH k(i, terms) AS (VALUES {_KIND_ROWS}) SELECT p_partkey, array_to_string(list_filter(terms, lambda x, j: lower(x) <> 'samsung' AND list_position(list_transform(terms, lambda y: lower(y)), lower(x)) = j), '|') AS terms FROM part JOIN k ON k.i = p_size % 8")
def i07(spark, d):
    kinds = F.array(*[F.lit(k) for k in dims.COMPETITORS])
    types = F.array(F.element_at(kinds, F.col("p_size") % 8 + 1))
    return _t(spark, d, "part").select("p_partkey", F.array_join(product.competitor_terms(types, F.lit("Samsung"), F.lit("https://www.shop.example.com/")), "|").alias("terms"))


@query("I09_canonical_brand", "WITH x AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_name ELSE p_name END AS name, CASE p_size % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'coupang' ELSE '' END AS host, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS fact FROM part) SELECT p_partkey, CASE WHEN host = 'acme' AND fact <> '' AND lower(split_part(name, ' ', 1)) = lower(fact) THEN host WHEN fact <> '' THEN fact ELSE host END AS brand FROM x")
def i09(spark, d):
    size, b = F.col("p_size"), F.col("p_brand")
    name = F.when(size % 2 == 0, F.concat(b, F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    url = F.when(size % 3 == 0, "https://www.acme.com/x").when(size % 3 == 1, "https://m.coupang.com/").otherwise("https://www.com/")
    fact = F.when(size % 5 == 0, "").otherwise(b)
    return _t(spark, d, "part").select("p_partkey", product.canonical_brand(fact, name, url).alias("brand"))


@query("E16_quality_warnings", f"{S.classed()} SELECT page_id, array_to_string(list_filter([CASE WHEN chars < 100 THEN 'fallback_used' END, CASE WHEN sufficiency = 'borderline' THEN 'borderline_sufficiency' END, CASE WHEN page_class IN {dims.WARNING_CLASSES!r} THEN 'page_class:' || page_class END, CASE WHEN len(price) = 0 THEN 'thin_pack' END], lambda x: x IS NOT NULL), '|') AS warnings FROM classed")
def e16(spark, d):
    p = pages.classified(_t(spark, d, "pages"))
    return p.select("page_id", F.array_join(product.quality_warnings(F.col("chars") < 100, F.lit(False), F.col("sufficiency"), F.col("page_class"), F.size("price") == 0), "|").alias("warnings"))


@query("E02_fact_union", "WITH s AS (SELECT p_brand AS url, p_type AS type, p_name AS value, 0 AS rank FROM part WHERE p_size < 10 UNION ALL SELECT p_brand, p_type, upper(p_name), 1 FROM part WHERE p_size >= 10) SELECT url, type, value, rank FROM (SELECT *, min(rank) OVER (PARTITION BY url, type) AS best FROM s) WHERE rank = best")
def e02(spark, d):
    p = _t(spark, d, "part")
    side = lambda x, v: x.select(F.col("p_brand").alias("url"), F.col("p_type").alias("type"), v.alias("value"))
    return facts.fact_union(side(p.where("p_size < 10"), F.col("p_name")), side(p.where("p_size >= 10"), F.upper("p_name")))


@query("H12_confidence", f"{S.snapshot()} SELECT confidence, count(*) AS pages FROM snap GROUP BY confidence")
def h12(spark, d):
    return pages.snapshot(_t(spark, d, "pages")).groupBy("confidence").agg(F.count("*").alias("pages"))


@query("H13_sellability", f"{S.snapshot()} SELECT sellability, count(*) AS pages FROM snap GROUP BY sellability")
def h13(spark, d):
    return pages.snapshot(_t(spark, d, "pages")).groupBy("sellability").agg(F.count("*").alias("pages"))


@query("R01_match_labels", f"{S.ROWS} SELECT category, naver_match, google_match, count(*) AS n FROM r GROUP BY ALL")
def r01(spark, d):
    return candidate_rows(spark, d).groupBy("category", "naver_match", "google_match").agg(F.count("*").alias("n"))


@query("F07_invalid_exact", f"{S.ISSUES} SELECT url, ord, ({S._EXACT}) AS invalid FROM k3")
def f07(spark, d):
    kw, brand, name = F.col("keyword"), F.col("brand"), F.col("product_name")
    return candidate_rows(spark, d).select("url", "ord", K.invalid_exact(kw, F.col("category"), name, K.short_name(name, brand), brand).alias("invalid"))


@query("A09_malformed_counts", f"{S.ISSUES} SELECT url, count(*) FILTER (category <> 'negative' AND len(hard) > 0) AS malformed, count(*) FILTER (category = 'negative' AND len(hard) > 0) AS invalid_negatives FROM iss GROUP BY url")
def a09(spark, d):
    bad = F.size("hard_issues") > 0
    r = rows.with_issues(candidate_rows(spark, d))
    return r.groupBy("url").agg(F.count_if((F.col("category") != dims.NEGATIVE) & bad).alias("malformed"), F.count_if((F.col("category") == dims.NEGATIVE) & bad).alias("invalid_negatives"))


@query("A10_job_evaluation", f"{S.METRICS.replace('SELECT *, array_to_string', ', m AS (SELECT *, array_to_string')}) SELECT platform, count(*) AS urls, count(*) FILTER (failures = '') AS passed, bool_and(failures = '') AS gate FROM m GROUP BY platform")
def a10(spark, d):
    m = rows.url_metrics(candidate_rows(spark, d))
    return m.groupBy("platform").agg(F.count("*").alias("urls"), F.count_if(F.col("failures") == "").alias("passed"), F.bool_and(F.col("failures") == "").alias("gate"))


@query("A14_drop_report", f"{S.ISSUES}, d AS (SELECT url, ord, unnest(hard) AS reason, 'policy' AS stage FROM iss) SELECT stage, reason, count(*) AS n FROM d GROUP BY stage, reason UNION ALL SELECT 'low_information', 'soft', count(*) FROM iss WHERE list_contains(issues, 'low_information')")
def a14(spark, d):
    """Rows are judged once, and all issues counted together; the soft one is counted even where there is none."""
    issues = rows_of(rows.with_issues(candidate_rows(spark, d)), F.col("issues"), item="reason").groupBy("reason").agg(F.count("*").alias("n"))
    none = spark.range(1).select(F.lit("low_information").alias("reason"), F.lit(0).cast("long").alias("n"))
    n = issues.where(F.col("reason").isin("low_information", *dims.HARD_ISSUES)).unionByName(none).groupBy("reason").agg(F.sum("n").alias("n"))
    soft = F.col("reason") == "low_information"
    return n.select(F.when(soft, "low_information").otherwise("policy").alias("stage"), F.when(soft, "soft").otherwise(F.col("reason")).alias("reason"), "n")


@query("A17_run_overlap", f"{_CHOSEN}, b AS (SELECT url, keyword FROM r WHERE category <> 'negative' AND ord <= 10) SELECT coalesce(c.url, b.url) AS url, count(*) FILTER (c.keyword IS NOT NULL AND b.keyword IS NOT NULL) AS shared, count(*) FILTER (b.keyword IS NULL) AS only_a, count(*) FILTER (c.keyword IS NULL) AS only_b FROM (SELECT DISTINCT url, keyword FROM chosen) c FULL JOIN (SELECT DISTINCT url, keyword FROM b) b ON b.url = c.url AND b.keyword = c.keyword GROUP BY coalesce(c.url, b.url)")
def a17(spark, d):
    r = candidate_rows(spark, d)
    one = rows.select_rows(rows.selection_scores(r), 12).select("url", "keyword", F.lit(1).alias("a")).distinct()
    two = r.where("category != 'negative' and ord <= 10").select("url", "keyword", F.lit(1).alias("b")).distinct()
    both = one.join(spread(two), ["url", "keyword"], "full")
    return both.groupBy("url").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


# -- cache and export


@query("C01_cache_lookup", f"WITH p AS (SELECT page_id, {S.canonical('url')} AS u FROM pages), c AS (SELECT DISTINCT sha256(u) AS k FROM p WHERE page_id % 2 = 0) SELECT p.page_id, c.k IS NOT NULL AS hit FROM p LEFT JOIN c ON c.k = sha256(p.u)")
def c01(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.sha2(web.canonical_url(F.col("url")), 256).alias("k"))
    return p.join(p.where("page_id % 2 = 0").select("k", F.lit(True).alias("h")).distinct(), "k", "left").select("page_id", F.col("h").isNotNull().alias("hit"))


@query("C03_component_split", f"{S.ROWS} SELECT url, count(*) FILTER (naver_match <> '') AS naver_rows, count(*) FILTER (google_match <> '') AS google_rows FROM r GROUP BY url")
def c03(spark, d):
    listed = candidate_rows(spark, d).groupBy("url").agg(F.collect_list(F.struct("keyword", "naver_match", "google_match")).alias("rows"))
    return listed.select("url", F.size(F.filter("rows", lambda x: x["naver_match"] != "")).cast("long").alias("naver_rows"), F.size(F.filter("rows", lambda x: x["google_match"] != "")).cast("long").alias("google_rows"))


@query("K02_combined_counts", f"{S.ROWS} SELECT product_name AS job_id, count(DISTINCT url) AS successes, count(*) AS n_rows, min(url) AS first_url FROM r GROUP BY product_name")
def k02(spark, d):
    per_url = candidate_rows(spark, d).groupBy("product_name", "url").agg(F.count("*").alias("n"))
    combined = per_url.groupBy(F.col("product_name").alias("job_id")).agg(F.sort_array(F.collect_list(F.struct("url", "n"))).alias("items"))
    return combined.select("job_id", F.size("items").cast("long").alias("successes"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_rows"), F.element_at("items", 1)["url"].alias("first_url"))


@query("K01_per_url_json", f"{S.ROWS} SELECT url, count(*) AS n, arg_min(keyword, ord) AS first_keyword, arg_max(keyword, ord) AS last_keyword, arg_min(naver_match, ord) AS first_match FROM r GROUP BY url")
def k01(spark, d):
    """Nested JSON of each product's export rows in order, read back field by field."""
    r = candidate_rows(spark, d).withColumn("quality_warning", F.lit(False))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*dims.EXPORT_COLUMNS).alias("row")))), lambda x: x["row"])
    made = r.groupBy("url").agg(F.to_json(F.struct(listed.alias("rows"))).alias("payload"), F.count("*").alias("n"))
    at = lambda i, c: F.get_json_object("payload", f"$.rows[{i}].{c}")
    return made.select("url", "n", at(0, "keyword").alias("first_keyword"), at(len(dims.TEMPLATES) - 1, "keyword").alias("last_keyword"), at(0, "naver_match").alias("first_match"))


_SLOT_SQL = f"{S.ROWS}, sl AS (SELECT *, CASE category WHEN 'brand' THEN CASE WHEN contains(lower(keyword), lower(brand)) AND contains(lower(keyword), lower(type)) THEN 'brand_with_type' ELSE 'product_name' END WHEN 'generic_category' THEN 'generic_type_phrase' WHEN 'feature_attribute' THEN CASE WHEN NOT regexp_matches(lower(keyword), {S.q(K.UNIT_ONLY)}) AND contains(lower(keyword), '성능') THEN 'core_attribute' ELSE 'spec' END WHEN 'competitor_comparison' THEN 'competitor_brand_type' WHEN 'purchase_intent' THEN CASE WHEN keyword = product_name || ' 구매' THEN 'navigational_alias' ELSE 'brand_with_type' END WHEN 'long_tail' THEN 'use_case_phrase' WHEN 'benefit_price' THEN CASE WHEN regexp_matches(lower(keyword), {S.q(slots.PRICE_BAND)}) THEN 'price_band' ELSE 'product_price' END WHEN 'season_event' THEN CASE WHEN contains(keyword, '선물') THEN 'grounded_event' ELSE 'seasonal_context' END WHEN 'problem_solution' THEN 'problem_noun_phrase' ELSE 'negative_exclusion' END AS slot_type FROM r)"


def _slotted(spark, d):
    r = candidate_rows(spark, d)
    return r.withColumn("slot_type", slots.slot_type(aliases=F.array(F.concat("product_name", F.lit(" 구매"))), brand=F.col("brand"), types=F.array("type"), attributes=F.array(F.lit("성능")), events=F.array(F.lit("선물"))))


@query("G05_slot_types", f"{_SLOT_SQL} SELECT url, ord, slot_type FROM sl")
def g05(spark, d):
    return _slotted(spark, d).select("url", "ord", "slot_type")


_PLAN_SQL = ", ".join(f"('{c}', '{s}', 2)" for c, s in dims.DEFAULT_SLOTS.items())
_GAP_SQL = f"{_SLOT_SQL}, p(category, slot_type, target) AS (VALUES {_PLAN_SQL}), c AS (SELECT url, category, slot_type, count(*) FILTER (naver_match <> '') AS n, count(*) FILTER (google_match <> '') AS g FROM sl GROUP BY url, category, slot_type), f AS (SELECT u.url, p.category, p.slot_type, greatest(0, p.target - coalesce(c.n, 0))::BIGINT AS naver_gap, greatest(0, p.target - coalesce(c.g, 0))::BIGINT AS google_gap FROM (SELECT DISTINCT url FROM sl) u CROSS JOIN p LEFT JOIN c ON c.url = u.url AND c.category = p.category AND c.slot_type = p.slot_type), gaps AS (SELECT *, greatest(naver_gap, google_gap) AS gap FROM f WHERE naver_gap > 0 OR google_gap > 0)"


def _slot_gaps(spark, d):
    plan = spark.createDataFrame([(c, s, 2) for c, s in dims.DEFAULT_SLOTS.items()], "category string, slot_type string, target int")
    return slots.slot_gaps(_slotted(spark, d), plan)


@query("A03_slot_gaps", f"{_GAP_SQL} SELECT url, category, slot_type, naver_gap, google_gap, gap FROM gaps")
def a03(spark, d):
    return _slot_gaps(spark, d)


@query("A03_gap_totals", f"{_GAP_SQL} SELECT url, category, sum(naver_gap + google_gap)::BIGINT AS missing FROM gaps GROUP BY GROUPING SETS ((url, category), (url))")
def a03t(spark, d):
    return slots.gap_totals(_slot_gaps(spark, d))
