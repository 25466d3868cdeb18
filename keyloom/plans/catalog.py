"""Registered queries over the driver's tables, each with the DuckDB SQL it is held against (``sql`` beside it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import keywords as K
from keyloom.functions import web
from keyloom.functions.arrays import texts, where_here
from keyloom.operators import accuracy, facts, jobs, pages, quota, rows
from keyloom.plans import sql as S
from keyloom.workers import ready

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("https://shop.example.com/product/"), "p_partkey").alias("url"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.array(F.when(F.col("p_size") % 5 == 0, "skincare").otherwise("general")).alias("types"), F.filter(texts(S._RIVALS), lambda c: F.lower(c) != F.lower("p_brand")).alias("competitors"), texts(("ECONOMY", "SMALL")).alias("category_terms"), F.array("p_name").alias("identity"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.keyword_rows(products(spark, sf_dir))


# -- URLs


#: Urls that hold what is easily lost: values that end in "=", escapes that are none, signs that form encoding keeps or changes, ports, users, repeats.
_URLS = "concat(CASE p_size % 4 WHEN 0 THEN 'HTTPS://Shop.Example.com:443//p//' WHEN 1 THEN 'http://u:w@h.example.com:8080/p/' WHEN 2 THEN 'http://h.example.com:080/p' ELSE 'https://h.example.com/p/x/' END, '?id=', p_partkey, CASE p_size % 3 WHEN 0 THEN '==' WHEN 1 THEN '%3D' ELSE '' END, '&d=100%zz&a=~x*y+z&b=%41%20é&empty=&flag&utm_source=q&Ref=1&ref=2', CASE WHEN p_size % 2 = 0 THEN '&a=0' ELSE '&c=a=b' END, '#f?x=1')"


@query("U01_canonical_url", f"SELECT page_id, {S.canonical('url')} AS canonical_url FROM (SELECT page_id, url FROM pages UNION ALL SELECT p_partkey + 1000000, {_URLS} FROM part)")
def u01(spark, d):
    made = _t(spark, d, "part").select((F.col("p_partkey") + 1000000).alias("page_id"), F.expr(_URLS).alias("url"))
    return _t(spark, d, "pages").select("page_id", "url").unionByName(made).select("page_id", web.canonical_url(F.col("url")).alias("canonical_url"))


_REFERENCES = {"caf&eacute; &euro;": "café €", "&#8361; 38&hellip;": "₩ 38…", "&#xE9;&AMP;&copy2": "é&©2", "a&amp;lt;b &notit; &unknown;": "a&lt;b ¬it; &unknown;", "x&nbsp;&nbsp;y &#150; &#0;": "x y – \ufffd"}


@query("H01_references", "SELECT p_partkey, 'T' || p_partkey || ' ' || CASE p_size % 5 " + " ".join(f"WHEN {i} THEN {S.q(v)}" for i, v in enumerate(_REFERENCES.values())) + " END AS title FROM part")
def h01r(spark, d):
    said = F.get(texts(tuple(_REFERENCES)), F.col("p_size") % 5)
    html = F.concat(F.lit("<p>x</p><TITLE a=1>\n T"), F.col("p_partkey").cast("string"), F.lit("  "), said, F.lit(" \t</TITLE><title>y</title>"))
    return _t(spark, d, "part").select("p_partkey", web.title(html).alias("title"))


@query("U02_cache_key", f"SELECT page_id, 'kwg:' || sha256({S.canonical('url')}) || ':platform:naver_sa:policy:v1:taxonomy:v1:generator:v1' AS cache_key FROM pages")
def u02(spark, d):
    return _t(spark, d, "pages").select("page_id", web.cache_key(web.canonical_url(F.col("url")), "naver_sa").alias("cache_key"))


@query("U03_intent_id", "SELECT p_partkey, substr(sha1(p_type || '|' || p_name), 1, 16) AS intent_id FROM part")
def u03(spark, d):
    return _t(spark, d, "part").select("p_partkey", web.intent_id(F.col("p_type"), F.col("p_name")).alias("intent_id"))


@query("U04_host_brand", S.HOST_BRAND)
def u04(spark, d):
    return _t(spark, d, "pages").select("page_id", web.host_brand(F.col("url")).alias("brand"))


@query("U05_policy_host_brand", f"SELECT page_id, coalesce(list_filter(string_split({S.host('url')}, '.'), lambda x: x <> '' AND x NOT IN {dims.HOST_NOISE!r})[1], '') AS brand FROM pages")
def u05(spark, d):
    return _t(spark, d, "pages").select("page_id", web.policy_host_brand(F.col("url")).alias("brand"))


# -- pages


@query("H01_title", f"SELECT page_id, {S.title('html')} AS title FROM pages")
def h01(spark, d):
    return _t(spark, d, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query("H02_visible_text", f"SELECT page_id, {S.visible('html')} AS text FROM pages")
def h02(spark, d):
    return _t(spark, d, "pages").select("page_id", web.visible_text(F.col("html")).alias("text"))


@query("H03_blocks", f"SELECT page_id, len(b) AS n, array_to_string(b, '|') AS blocks FROM (SELECT page_id, {S.blocks(S.visible('html'))} AS b FROM pages)")
def h03(spark, d):
    return _t(spark, d, "pages").select("page_id", web.blocks(web.visible_text(F.col("html"))).alias("b")).select("page_id", F.size("b").cast("long").alias("n"), F.array_join("b", "|").alias("blocks"))


_SNAP = ("page_id", "chars", "hangul", "latin", "confidence", "sellability", "sufficiency", "stock_state")


@query("H09_signals", f"{S.snapshot()} SELECT page_id, array_to_string(buy, '|') AS buy, array_to_string(promo, '|') AS promo, array_to_string(support, '|') AS support, array_to_string(download, '|') AS download, array_to_string(price, '|') AS price, array_to_string(blocker, '|') AS blocker FROM snap")
def h09(spark, d):
    return pages.snapshot(_t(spark, d, "pages")).select("page_id", *[F.array_join(c, "|").alias(c) for c in ("buy", "promo", "support", "download", "price", "blocker")])


@query("H10_product_tokens", f"{S.snapshot()} SELECT page_id, array_to_string(tokens, '|') AS tokens FROM snap")
def h10(spark, d):
    return pages.snapshot(_t(spark, d, "pages")).select("page_id", F.array_join("tokens", "|").alias("tokens"))


@query("H11_density", f"{S.snapshot()} SELECT page_id, " + ", ".join(f"CASE WHEN chars > 0 THEN round(len({c})::DOUBLE / chars, 6) ELSE 0.0::DOUBLE END AS {c}_density" for c in ("promo", "support", "download")) + " FROM snap")
def h11(spark, d):
    return pages.snapshot(_t(spark, d, "pages")).select("page_id", "promo_density", "support_density", "download_density")


@query("H15_snapshot", f"{S.snapshot()} SELECT page_id, chars, hangul, latin, confidence, sellability, sufficiency, stock_state, sellability_state, title, product_name, spoken AS locale_detected FROM snap")
def h15(spark, d):
    return pages.snapshot(_t(spark, d, "pages")).select("page_id", *[F.col(c).cast("long").alias(c) for c in ("chars", "hangul", "latin")], "confidence", "sellability", "sufficiency", "stock_state", "sellability_state", "title", "product_name", "locale_detected")


@query("H14_language_shares", f"{S.snapshot()} SELECT page_id, CASE WHEN starts_with(coalesce(lang, ''), 'ko') THEN greatest(0.6::DOUBLE, round(hangul::DOUBLE / greatest(hangul + latin, 1), 4)) ELSE round(hangul::DOUBLE / greatest(hangul + latin, 1), 4) END AS ko, round(latin::DOUBLE / greatest(hangul + latin, 1), 4) AS en FROM snap")
def h14(spark, d):
    return pages.snapshot(_t(spark, d, "pages")).select("page_id", "ko", "en")


_MARKED = "'# ' || source || chr(10) || '> - 1. [' || source || '](http://a.b/c) ![pic](d.png) `code`' || chr(10) || '```' || chr(10) || 'gone' || chr(10) || '```' || chr(10) || chr(10) || text"


@query("H17_markdown_text", f"SELECT doc_id, {S.tidied(S.unescape(chr(39).join(['replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' + _MARKED + ', ', '(?s)```.*?```', ', chr(10), ', 'g', '), ', '!\\[([^\\]]*)\\]\\([^)]+\\)', ', ', '\\1', ', ', 'g', '), ', '\\[([^\\]]+)\\]\\([^)]+\\)', ', ', '\\1', ', ', 'g', '), ', '(?m)^[>#*\\-0-9.\\s]+', ', ', '', ', ', 'g', '), ', '`', ', ', '', ')'])))} AS text FROM documents")
def h17(spark, d):
    lit = F.lit
    marked = F.concat(lit("# "), "source", lit("\n> - 1. ["), "source", lit("](http://a.b/c) ![pic](d.png) `code`\n```\ngone\n```\n\n"), "text")
    return _t(spark, d, "documents").select("doc_id", web.markdown_text(marked).alias("text"))


@query("P01_page_class", f"{S.classed()} SELECT page_class, count(*) AS pages, sum(chars)::BIGINT AS chars FROM classed GROUP BY page_class")
def p01(spark, d):
    return pages.classified(_t(spark, d, "pages")).groupBy("page_class").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))


@query("P02_supported_gate", f"{S.classed()} SELECT page_id, page_class, supported, CASE WHEN NOT supported THEN page_class END AS failure_code, page_class IN {dims.WARNING_CLASSES!r} AS quality_warning FROM classed")
def p02(spark, d):
    return pages.classified(_t(spark, d, "pages")).select("page_id", "page_class", "supported", "failure_code", "quality_warning")


@query("P04_fallback_reason", f"{S.classed()} SELECT page_id, CASE WHEN page_class IN ('blocked_page','waiting_page') THEN 'blocked_or_waiting_surface' WHEN page_class IN ('non_product_page','promo_heavy_commerce_landing') AND len(price) = 0 AND len(buy) = 0 THEN 'client_side_render_suspected' WHEN page_class IN ('non_product_page','promo_heavy_commerce_landing') THEN 'thin_product_evidence' WHEN chars < 1200 AND payloads = 0 AND (len(price) = 0 OR len(buy) = 0) THEN 'thin_product_evidence' END AS reason FROM classed")
def p04(spark, d):
    return pages.classified(_t(spark, d, "pages")).select("page_id", pages.fallback_reason().alias("reason"))


@query("P05_failure_hints", f"{S.classed()} SELECT page_id, array_to_string(list_concat(CASE page_class " + " ".join(f"WHEN {S.q(k)} THEN {S.lst(v)}" for k, v in dims.CLASS_HINTS.items()) + f" ELSE [page_class || {S.q(dims.OTHER_CLASS_HINT)}] END, list_filter([CASE WHEN payloads = 0 THEN {S.q(dims.NO_DATA_HINT)} END, CASE WHEN len(buy) = 0 THEN {S.q(dims.NO_BUY_HINT)} END], lambda x: x IS NOT NULL)), '|') AS hints FROM classed WHERE NOT supported")
def p05(spark, d):
    return where_here(pages.classified(_t(spark, d, "pages")), ~F.col("supported")).select("page_id", F.array_join(pages.failure_hints(), "|").alias("hints"))


# -- keyword rows

_KEY = "url, ord"


@query("R02_keyword_rows", f"{S.ROWS} SELECT url, ord, category, keyword, naver_match, google_match FROM r")
def r02(spark, d):
    return candidate_rows(spark, d).select("url", "ord", "category", "keyword", "naver_match", "google_match")


@query("R03_platform_rows", f"{S.ROWS} SELECT platform, label, count(*) AS n, count(DISTINCT url) AS urls FROM (SELECT url, 'naver_sa' AS platform, naver_match AS label FROM r UNION ALL SELECT url, 'google_sa', google_match FROM r) GROUP BY ALL")
def r03(spark, d):
    return rows.by_platform(candidate_rows(spark, d)).groupBy("platform", "label").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("F01_tokens", f"SELECT doc_id, len({S.tok('text', K.POLICY_TOKEN)}) AS policy, len({S.tok('text', K.EVAL_TOKEN)}) AS eval, len({S.tok('text', K.FAMILY_TOKEN)}) AS family FROM documents")
def f01(spark, d):
    n = lambda p: F.size(K.tokens(F.col("text"), p)).cast("long")
    return _t(spark, d, "documents").select("doc_id", n(K.POLICY_TOKEN).alias("policy"), n(K.EVAL_TOKEN).alias("eval"), n(K.FAMILY_TOKEN).alias("family"))


@query("F02_policy_issues", f"{S.ISSUES} SELECT {_KEY}, array_to_string(issues, '|') AS issues FROM iss")
def f02(spark, d):
    return rows.with_issues(candidate_rows(spark, d)).select("url", "ord", F.array_join("issues", "|").alias("issues"))


@query("F03_hard_filter", f"{S.ISSUES} SELECT category, count(*) FILTER (len(hard) = 0) AS kept, count(*) FILTER (len(hard) > 0) AS dropped FROM iss GROUP BY category")
def f03(spark, d):
    hard = F.size("hard_issues")
    return rows.with_issues(candidate_rows(spark, d)).groupBy("category").agg(F.count_if(hard == 0).alias("kept"), F.count_if(hard > 0).alias("dropped"))


@query("F04_repeated_phrase", f"WITH k AS (SELECT doc_id, {S.tok('text', K.POLICY_TOKEN)} AS t FROM documents), h AS (SELECT doc_id, t, {S.nondigit('t')} AS w FROM k), u AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM h) GROUP BY doc_id, x) GROUP BY doc_id) SELECT h.doc_id, {S.halves('t')} OR {S.neighbours('t')} OR (len(w) >= 3 AND (coalesce(u.n, 0) >= 3 OR w[1] = w[len(w)])) AS repeated FROM h LEFT JOIN u ON u.doc_id = h.doc_id")
def f04(spark, d):
    return _t(spark, d, "documents").select("doc_id", K.tokens(F.col("text")).alias("t")).select("doc_id", K.repeated_tokens(F.col("t")).alias("repeated"))


@query("F05_low_information", f"{S.ROWS} SELECT {_KEY}, {S.low_information('keyword')} AS low FROM r")
def f05(spark, d):
    return candidate_rows(spark, d).select("url", "ord", K.low_information(F.col("keyword")).alias("low"))


@query("F10_banned_terms", f"{S.ROWS} SELECT banned, count(*) AS n FROM (SELECT {S.banned()} AS banned FROM r) GROUP BY banned")
def f10(spark, d):
    return candidate_rows(spark, d).withColumn("banned", rows.banned_term()).groupBy("banned").agg(F.count("*").alias("n"))


@query("D01_ordered_distinct", "WITH k AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: " + S.collapse("x") + "), lambda x: x <> '') AS v FROM documents), u AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k)), f AS (SELECT doc_id, min(i) AS i FROM u GROUP BY doc_id, lower(x)) SELECT d.doc_id, coalesce(count(f.i), 0) AS n, coalesce(string_agg(u.x, '|' ORDER BY u.i), '') AS lines FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = f.doc_id AND u.i = f.i GROUP BY d.doc_id")
def d01(spark, d):
    lines = web.ordered_distinct(F.split(F.coalesce("text", F.lit("")), "\n+"))
    return _t(spark, d, "documents").select("doc_id", lines.alias("v")).select("doc_id", F.size("v").cast("long").alias("n"), F.array_join("v", "|").alias("lines"))


@query("D02_signatures", f"{S.ROWS} SELECT {_KEY}, {S.signature('keyword')} AS signature, {S.family('keyword')} AS family FROM r")
def d02(spark, d):
    k = F.col("keyword")
    return candidate_rows(spark, d).select("url", "ord", K.semantic_signature(k).alias("signature"), K.family_key(k).alias("family"))


@query("D03_selection_scores", f"{S.SCORED} SELECT {_KEY}, score FROM scored")
def d03(spark, d):
    return rows.selection_scores(candidate_rows(spark, d)).select("url", "ord", "score")


_ORDER = "score DESC, CASE WHEN evidence_tier = 'direct' THEN 0 ELSE 1 END, ord"
_POS = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(dims.CATEGORY_TARGETS)) + " END"
#: The best of each category, in the order of categories, then the rest by score up to twelve; rows equal to a best one in category, keyword and labels go.
_CHOSEN = f"{S.SCORED}, lead AS (SELECT *, row_number() OVER (PARTITION BY url, category ORDER BY {_ORDER}) = 1 AS first FROM scored), rest AS (SELECT l.* FROM lead l WHERE NOT first AND NOT EXISTS (SELECT 1 FROM lead f WHERE f.first AND f.url = l.url AND f.category = l.category AND f.keyword = l.keyword)), placed AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY first DESC, CASE WHEN first THEN {_POS} END, {_ORDER}) AS place FROM (SELECT * FROM lead WHERE first UNION ALL SELECT * FROM rest)), chosen AS (SELECT * FROM placed WHERE place <= 12)"


@query("D04_select_rows", f"{_CHOSEN} SELECT {_KEY}, score, place FROM chosen")
def d04(spark, d):
    return rows.select_rows(rows.selection_scores(candidate_rows(spark, d)), 12).select("url", "ord", "score", F.col("place").cast("long").alias("place"))


@query("D05_selection_summary", f"{_CHOSEN}, cut AS (SELECT url, min(score) AS cutline FROM chosen GROUP BY url), kept AS (SELECT DISTINCT url, category, keyword FROM chosen) SELECT s.url, s.category, count(c.ord) AS selected, count(*) FILTER (k.url IS NULL) AS dropped, any_value(t.cutline) AS cutline FROM scored s LEFT JOIN chosen c ON c.url = s.url AND c.ord = s.ord LEFT JOIN kept k ON k.url = s.url AND k.category = s.category AND k.keyword = s.keyword JOIN cut t ON t.url = s.url GROUP BY s.url, s.category")
def d05(spark, d):
    scored = rows.selection_scores(candidate_rows(spark, d))
    return rows.selection_summary(scored, rows.select_rows(scored, 12))


@query("A01_validation", S.VALIDATION)
def a01(spark, d):
    return rows.validation(candidate_rows(spark, d)).select("url", "platform", "positives", "negatives", "weak", "violations", "failure_detail", "failure_code", "status")


@query("A04_url_metrics", S.METRICS)
def a04(spark, d):
    return rows.url_metrics(candidate_rows(spark, d)).select("url", "platform", "total", "fillers", F.col("natural_sum").cast("long").alias("natural_sum"), "exact_distinct", "semantic_distinct", "reasoned", "malformed", "invalid_negatives", "failures")


_COUNTS = "n AS (SELECT url AS u, platform AS p, " + ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in dims.IDEAL_SHARES) + " FROM sides GROUP BY url, platform)"
_DEVIATION = "(0.0::DOUBLE + " + " + ".join(f"abs(n_{c}::DOUBLE / total - {v}::DOUBLE)" for c, v in dims.IDEAL_SHARES.items()) + ") / 9"


@query("A04_auto_score", S.METRICS.split("SELECT *, array_to_string")[0] + f", {_COUNTS}, v AS (SELECT a.*, {_DEVIATION} AS deviation FROM a JOIN n ON u = url AND p = platform) SELECT url, platform, deviation, least(100::DOUBLE, greatest(0::DOUBLE, natural_sum::DOUBLE / (total * 100) * 30 + greatest(0::DOUBLE, 10 - deviation * 100) + semantic_distinct::DOUBLE / total * 10 + reasoned::DOUBLE / total * 10 - (fillers::DOUBLE / total * 60 + (malformed * 3 + invalid_negatives)::DOUBLE / 2))) AS auto_score FROM v")
def a04b(spark, d):
    return rows.url_metrics(candidate_rows(spark, d)).select("url", "platform", "auto_score", "deviation")


@query("A05_naturalness", f"{S.ROWS} SELECT {_KEY}, {S.natural('keyword')} AS naturalness FROM r")
def a05(spark, d):
    return candidate_rows(spark, d).select("url", "ord", K.naturalness(F.col("keyword"), F.lit(False)).cast("long").alias("naturalness"))


@query("A06_filler", f"{S.ROWS} SELECT category, count(*) FILTER ({S.filler('keyword')}) AS fillers, count(*) AS n FROM r GROUP BY category")
def a06(spark, d):
    return candidate_rows(spark, d).groupBy("category").agg(F.count_if(K.filler(F.col("keyword"))).alias("fillers"), F.count("*").alias("n"))


@query("A07_duplicate_families", f"{S.ROWS}, n AS (SELECT url, ord, keyword, {S.signature('keyword')} AS signature FROM r WHERE category <> 'negative'), g AS (SELECT url, signature, count(*) AS n, list(keyword ORDER BY ord)[1:5] AS k FROM n GROUP BY url, signature HAVING count(*) > 1), p AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC, signature) AS place FROM g) SELECT url, signature, n, array_to_string(k, '|') AS keywords FROM p WHERE place <= 10")
def a07(spark, d):
    return rows.duplicate_families(candidate_rows(spark, d))


@query("A02_category_gaps", f"{S.ROWS}, c AS (SELECT url, category, count(*) AS n FROM r WHERE category <> 'negative' GROUP BY url, category), u AS (SELECT DISTINCT url FROM c), p(category, seats) AS (VALUES {', '.join(f'({c!r}, 2)' for c in dims.CATEGORY_TARGETS)}) SELECT u.url AS key, p.category, greatest(0, p.seats - coalesce(c.n, 0))::BIGINT AS gap FROM u CROSS JOIN p LEFT JOIN c ON c.url = u.url AND c.category = p.category")
def a02(spark, d):
    counts = candidate_rows(spark, d).where(F.col("category") != dims.NEGATIVE).groupBy(F.col("url").alias("key"), "category").agg(F.count("*").alias("n"))
    return quota.category_gaps(counts, quota.categories(spark).select("category", F.lit(2).alias("seats")))


@query("K03_export_rows", f"{S.ROWS} SELECT url, product_name, category, keyword, naver_match, google_match, reason, false AS quality_warning FROM r")
def k03(spark, d):
    return rows.export_rows(candidate_rows(spark, d))


@query("R07_overused_tokens", f"{S.ROWS}, tk AS (SELECT url, unnest({S.tok('keyword', K.EVAL_TOKEN)}) AS w FROM r WHERE category <> 'negative'), c AS (SELECT url, w, count(*) AS n FROM tk WHERE NOT regexp_matches(w, '^[0-9]+$|^[가-힣]$') GROUP BY url, w HAVING count(*) >= 2), p AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC, w) AS place FROM c) SELECT url, w, n FROM p WHERE place <= 12")
def r07(spark, d):
    w = candidate_rows(spark, d).where(F.col("category") != dims.NEGATIVE).select("url", F.explode(K.tokens(F.col("keyword"), K.EVAL_TOKEN)).alias("w"))
    c = w.where(~F.col("w").rlike("^[0-9]+$|^[가-힣]$")).groupBy("url", "w").agg(F.count("*").alias("n")).where("n >= 2")
    place = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("n"), "w"))
    return c.withColumn("place", place).where("place <= 12").drop("place")


# -- quotas


@query("G01_largest_remainder", S.LARGEST)
def g01(spark, d):
    totals = _t(spark, d, "part").select(F.col("p_size").alias("total")).distinct().unionByName(spark.sql("SELECT explode(array(0, 9, 100, 160, 161, 999)) AS total").selectExpr("cast(total as int) as total")).distinct()
    return quota.largest_remainder(totals, quota.categories(spark))


@query("G02_divisor_plan", S.DIVISOR)
def g02(spark, d):
    demand = _t(spark, d, "part").groupBy(F.col("p_brand").alias("key"), F.col("p_type").alias("category")).agg(F.least(F.count("*"), F.lit(9)).cast("int").alias("available"), F.max("p_size").alias("target"), (F.min("p_size") % 4 / 4.0 + 1).alias("strength")).withColumn("total", F.lit(20))
    pos = F.dense_rank().over(Window.partitionBy("key").orderBy("category"))
    return quota.divisor_plan(demand.withColumn("pos", pos).withColumn("weight", F.col("target") * F.col("strength")))


@query("G03_slot_split", S.SLOTS)
def g03(spark, d):
    slots = _t(spark, d, "part").groupBy(F.col("p_brand").alias("key"), F.col("p_type").alias("slot")).agg(F.count_distinct("p_name").cast("int").alias("seeds"), F.max("p_size").alias("total")).withColumn("is_primary", F.col("slot") == "ECONOMY").withColumn("total", F.lit(17))
    return quota.slot_split(slots)


@query("I11_price_bands", "SELECT p_partkey, CASE WHEN b >= 1 THEN b || '만원대' ELSE '' END AS band FROM (SELECT p_partkey, floor(p_retailprice * 40 / 10000)::BIGINT AS b FROM part)")
def i11(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(K.price_bands(F.col("p_retailprice") * 40), F.lit(1)), F.lit("")).alias("band"))


# -- facts

_FACTS_SQL = "WITH f AS (SELECT p_brand AS url, p_partkey AS ord, 'product_name' AS type, p_name AS value FROM part UNION ALL SELECT p_brand, p_partkey + 100000000, 'Variant', upper(p_type) FROM part UNION ALL SELECT p_brand, p_partkey + 200000000, 'variant', lower(p_type) FROM part)"


def _fact_rows(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.col("p_brand").alias("url"), F.col("p_partkey").alias("ord"), F.lit("product_name").alias("type"), F.col("p_name").alias("value")).unionByName(p.select(F.col("p_brand").alias("url"), (F.col("p_partkey") + 100000000).alias("ord"), F.lit("Variant").alias("type"), F.upper("p_type").alias("value"))).unionByName(p.select(F.col("p_brand").alias("url"), (F.col("p_partkey") + 200000000).alias("ord"), F.lit("variant").alias("type"), F.lower("p_type").alias("value")))


@query("E03_distinct_facts", f"{_FACTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY url, lower(type), lower(value) ORDER BY ord) AS t FROM f) SELECT url, ord, type, value, 'f' || lpad((row_number() OVER (PARTITION BY url ORDER BY ord))::VARCHAR, 3, '0') AS fact_id FROM o WHERE t = 1")
def e03(spark, d):
    return facts.distinct_facts(_fact_rows(spark, d))


@query("E15_thin_packs", f"{_FACTS_SQL} SELECT url, count(DISTINCT CASE WHEN type IN {dims.BASE_FACTS!r} THEN type END) AS base, count(DISTINCT CASE WHEN type IN {dims.RICH_FACTS!r} THEN type END) AS rich, count(DISTINCT CASE WHEN type IN {dims.BASE_FACTS!r} THEN type END) < 3 OR count(DISTINCT CASE WHEN type IN {dims.RICH_FACTS!r} THEN type END) < 2 AS thin FROM f GROUP BY url")
def e15(spark, d):
    return facts.thin_packs(_fact_rows(spark, d), F.lit("commerce_pdp"))


@query("E14_sanitized_price", "SELECT o_orderkey, CASE WHEN length(x) BETWEEN 4 AND 6 THEN x END AS price FROM (SELECT o_orderkey, regexp_replace(o_orderkey || ' won', '[^0-9]', '', 'g') AS x FROM orders)")
def e14(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", facts.sanitized_price(F.concat(F.col("o_orderkey").cast("string"), F.lit(" won"))).alias("price"))


@query("E08_measurements", "SELECT doc_id, len(m) AS n, array_to_string(m, '|') AS found FROM (SELECT doc_id, regexp_extract_all(lower(text), '(?:^|[^\\p{L}\\p{N}_])([0-9]+\\s?(?:ml|gb|tb|kg|mah|hz|mm|cm|inch|g|w))(?:$|[^\\p{L}\\p{N}_])', 1) AS m FROM documents)")
def e08(spark, d):
    return _t(spark, d, "documents").select("doc_id", facts.measurements(F.col("text")).alias("m")).select("doc_id", F.size("m").cast("long").alias("n"), F.array_join("m", "|").alias("found"))


# -- jobs: a customer is a job, its orders are tasks

_TASKS_SQL = "WITH tasks AS (SELECT o_custkey AS job_id, o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice > 400000 THEN 'FAILED_COLLECTION' WHEN o_totalprice > 300000 THEN 'COMPLETED_CACHED' ELSE 'COMPLETED' END WHEN 'O' THEN 'COMPLETED' ELSE CASE WHEN o_totalprice > 200000 THEN 'COMPLETED' ELSE 'RECEIVED' END END AS status FROM orders), agg AS (SELECT job_id, count(*) AS submitted, count(*) FILTER (status = 'COMPLETED_CACHED') AS cached, count(*) FILTER (status IN ('COMPLETED','COMPLETED_CACHED')) AS succeeded, count(*) FILTER (status LIKE 'FAILED%') AS failed, count(*) FILTER (status = 'RECEIVED') AS open FROM tasks GROUP BY job_id), stat AS (SELECT *, CASE WHEN open > 0 THEN 'PROCESSING' WHEN succeeded > 0 AND failed > 0 THEN 'PARTIAL_COMPLETED' WHEN succeeded > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM agg)"


def _tasks(spark, d):
    price, st = F.col("o_totalprice"), F.col("o_orderstatus")
    status = F.when(st == "F", F.when(price > 400000, "FAILED_COLLECTION").when(price > 300000, "COMPLETED_CACHED").otherwise("COMPLETED")).when(st == "O", "COMPLETED").otherwise(F.when(price > 200000, "COMPLETED").otherwise("RECEIVED"))
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("task_id"), status.alias("status"))


@query("A12_status_counts", f"{_TASKS_SQL} SELECT job_id, submitted, cached, succeeded, failed, open, status FROM stat")
def a12(spark, d):
    return jobs.status_counts(_tasks(spark, d))


@query("A11_job_status", f"{_TASKS_SQL} SELECT status, count(*) AS jobs, sum(submitted)::BIGINT AS tasks FROM stat GROUP BY status")
def a11(spark, d):
    return jobs.status_counts(_tasks(spark, d)).groupBy("status").agg(F.count("*").alias("jobs"), F.sum("submitted").alias("tasks"))


@query("Q03_terminal_jobs", f"{_TASKS_SQL} SELECT job_id, submitted, cached, succeeded, failed, status FROM stat WHERE open = 0")
def q03(spark, d):
    return jobs.terminal_jobs(_tasks(spark, d))


@query("K06_notifications", f"{_TASKS_SQL} SELECT job_id, status, '{{\"submitted\":' || submitted || ',\"succeeded\":' || succeeded || ',\"failed\":' || failed || '}}' AS counts FROM stat WHERE open = 0")
def k06(spark, d):
    return jobs.notifications(jobs.terminal_jobs(_tasks(spark, d)))


@query("K05_upsert", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS t FROM events) WHERE t = 1")
def k05(spark, d):
    return jobs.latest(_t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


_CACHE_SQL = f"WITH p AS (SELECT page_id, {S.canonical('url')} AS u FROM pages), c AS (SELECT DISTINCT u, 'naver_sa' AS pf FROM p WHERE page_id % 2 = 0 UNION SELECT DISTINCT u, 'google_sa' FROM p WHERE page_id % 3 = 0)"


@query("C02_cache_routes", f"{_CACHE_SQL} SELECT p.page_id AS task_id, p.u AS canonical_url, CASE WHEN n.u IS NOT NULL AND g.u IS NOT NULL THEN 'hit' WHEN n.u IS NOT NULL OR g.u IS NOT NULL THEN 'partial' ELSE 'miss' END AS route, CASE WHEN n.u IS NOT NULL AND g.u IS NOT NULL THEN '' WHEN n.u IS NOT NULL THEN 'google_sa' WHEN g.u IS NOT NULL THEN 'naver_sa' ELSE 'both' END AS generate FROM p LEFT JOIN (SELECT u FROM c WHERE pf = 'naver_sa') n ON n.u = p.u LEFT JOIN (SELECT u FROM c WHERE pf = 'google_sa') g ON g.u = p.u")
def c02(spark, d):
    p = _t(spark, d, "pages").select("page_id", web.canonical_url(F.col("url")).alias("canonical_url"))
    cache = p.where("page_id % 2 = 0").select("canonical_url", F.lit("naver_sa").alias("platform")).unionByName(p.where("page_id % 3 = 0").select("canonical_url", F.lit("google_sa").alias("platform")))
    return jobs.cache_routes(p.withColumnRenamed("page_id", "task_id"), cache)


@query("C04_merged_components", f"{S.ROWS}, m AS (SELECT url, 'naver_sa' AS component FROM r WHERE naver_match <> '' UNION ALL SELECT url, 'google_sa' FROM r WHERE google_match <> '') SELECT url, component, count(*) AS n FROM m GROUP BY url, component")
def c04(spark, d):
    r = candidate_rows(spark, d)
    return jobs.merged_components(r.where("naver_match <> ''"), r.where("google_match <> ''")).groupBy("url", "component").agg(F.count("*").alias("n"))


@query("C05_stale_entries", "WITH dead AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 20) SELECT event_id, e.user_id AS url FROM events e WHERE ts <= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND user_id IN (SELECT user_id FROM dead)")
def c05(spark, d):
    e = _t(spark, d, "events")
    cache = e.select("event_id", F.col("user_id").alias("url"), F.col("ts").alias("modified"))
    return jobs.stale_entries(cache, e.where("event_type = 'error' and value > 20").select(F.col("user_id").alias("url")), F.lit("2024-01-20").cast("timestamp")).select("event_id", "url")


# -- accuracy

_PAIRS_SQL = "WITH pairs AS (SELECT a.item_id AS id, a.text AS reference, b.text AS prediction FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), n AS (SELECT id, trim(regexp_replace(lower(reference), '[^0-9a-z가-힣]+', ' ', 'g')) AS r, trim(regexp_replace(lower(prediction), '[^0-9a-z가-힣]+', ' ', 'g')) AS p FROM pairs)"


def _pairs(spark, d):
    b = _t(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("reference")).join(b.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("prediction")), "id")


@query("A15_character_errors", f"{_PAIRS_SQL} SELECT id, levenshtein(r, p) AS errors, length(r) AS length FROM n")
def a15(spark, d):
    return accuracy.character_errors(_pairs(spark, d))


@query("A15_word_overlap", f"{_PAIRS_SQL}, a AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(list_filter(string_split(r, ' '), lambda x: x <> '')) AS w FROM n) GROUP BY id, w), b AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(list_filter(string_split(p, ' '), lambda x: x <> '')) AS w FROM n) GROUP BY id, w) SELECT coalesce(a.id, b.id) AS id, sum(least(coalesce(a.c, 0), coalesce(b.c, 0)))::BIGINT AS matched, sum(coalesce(a.c, 0))::BIGINT AS reference_words, sum(coalesce(b.c, 0))::BIGINT AS predicted_words FROM a FULL JOIN b ON a.id = b.id AND a.w = b.w GROUP BY coalesce(a.id, b.id)")
def a15w(spark, d):
    return accuracy.word_overlap(_pairs(spark, d))


@query("A13_golden_diff", f"{_CHOSEN}, norm AS (SELECT DISTINCT url, trim(regexp_replace(lower(keyword), '[|/_\\s]+', ' ', 'g')) AS keyword FROM chosen), keep AS (SELECT DISTINCT url, trim(regexp_replace(lower(keyword), '[|/_\\s]+', ' ', 'g')) AS keyword FROM r WHERE category = 'long_tail'), ban AS (SELECT DISTINCT url, trim(regexp_replace(lower(keyword), '[|/_\\s]+', ' ', 'g')) AS keyword FROM r WHERE category = 'benefit_price') SELECT url, keyword, 'missing' AS finding FROM keep WHERE (url, keyword) NOT IN (SELECT (url, keyword) FROM norm) UNION ALL SELECT url, keyword, 'forbidden' FROM ban WHERE (url, keyword) IN (SELECT (url, keyword) FROM norm)")
def a13(spark, d):
    r = candidate_rows(spark, d)
    chosen = rows.select_rows(rows.selection_scores(r), 12)
    return accuracy.golden_diff(chosen, r.where("category = 'long_tail'"), r.where("category = 'benefit_price'"))


@query("O08_merged_lines")
def o08(spark, d):
    """Greedy merging depends on lengths so far; it is tested against brute force."""
    c = _t(spark, d, "conversations")
    words = c.select(F.col("conv_id").alias("image"), F.col("turn").alias("tile"), F.posexplode(F.split("text", r"\s+")).alias("ord", "text"))
    return accuracy.merged_lines(words)


from keyloom.plans import deep, more, service  # noqa: E402,F401  registers the rest
