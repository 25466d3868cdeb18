"""Queries over pages with structured data, evidence, interpretation, banks, surfaces, recognised text and intents.

Where a rule has too many branches to state twice, the fixture names inputs one by one and the SQL names what each must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import responses, structured
from keyloom.functions.arrays import none, rows_of, texts
from keyloom.functions.tables import dealt
from keyloom.operators import bank, evidence, images, intents, interpret, labels, pages, product, recognised, reports, resolve, rows, surface
from keyloom.plans import sql as S
from keyloom.plans.catalog import _t, candidate_rows, query
from keyloom.scratch import written
from keyloom.sources import files

Q = S.q


def _case(values, of: str = "p_partkey") -> str:
    return f"CASE {of} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else v if isinstance(v, (int, float)) else Q(v)}" for i, v in enumerate(values)) + " END"


def _pick(values, of: str = "p_partkey") -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(of) % len(values))


def _part(spark, d) -> DataFrame:
    return dealt(_t(spark, d, "part"), "p_partkey")


# -- pages with structured data

_PAGE = (
    """concat('<html lang="ko-KR"><head><title>', p_name, ' ', p_size, 'ml | Acme Official</title><meta name="description" content="Retinol ', p_size, 'ml improves pore"><meta property="og:title" content="Acme ', p_name, '">"""
    """<script type="application/ld+json">', CASE p_size % 3 WHEN 0 THEN concat('{"@graph":[{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"item":{"name":"', p_type, '"}}]},{"@type":["Product","Thing"],"name":"', p_name, '","brand":{"name":"', p_brand, ' (KR)"},"offers":[{"price":"', p_size, ',500"}]}]}')"""
    """ WHEN 1 THEN concat('[{"@type":"product","name":"', p_name, '","manufacturer":"', p_brand, '","category":"https://x.com/c","offers":{"price":', p_size, '}}]') ELSE 'not json' END, '</script><script>var captcha = 1;</script></head><body><p>', """
    """CASE WHEN p_size % 2 = 0 THEN 'add to cart' ELSE 'read more' END, ' ₩ ', p_size, ',500</p>', repeat('<p>words about it</p>', p_size), '</body></html>')"""
)
_SHOP_URL = "concat(CASE p_size % 4 WHEN 0 THEN 'https://www.laneige.com/products/' WHEN 1 THEN 'https://shop.example.co.kr/p/' WHEN 2 THEN 'https://www.coupang.com/vp/' ELSE 'https://m.example.com/display/event/' END, p_partkey)"
_SHOP = f"SELECT p_partkey AS page_id, {_SHOP_URL} AS url, {_PAGE} AS html, CASE WHEN p_size % 3 = 0 THEN p_name END AS ld_name, NULL::VARCHAR AS ld_text, CASE WHEN p_size % 3 = 0 THEN p_brand || ' (KR)' END AS ld_brand, p_size % 3 = 0 AS ld_product, CASE WHEN p_size % 3 = 2 THEN 0 ELSE 1 END AS payloads FROM part"


def shop_pages(spark, d, *more: Column) -> DataFrame:
    return _part(spark, d).select(F.col("p_partkey").alias("page_id"), F.expr(_SHOP_URL).alias("url"), F.expr(_PAGE).alias("html"), *more)


@query("H05_json_ld", "SELECT p_partkey AS page_id, CASE WHEN p_size % 3 = 2 THEN 0 ELSE 1 END::BIGINT AS payloads FROM part")
def h05(spark, d):
    return shop_pages(spark, d).select("page_id", F.size(structured.json_ld(F.col("html"))).cast("long").alias("payloads"))


@query("H06_structured_products", "SELECT p_partkey AS page_id, CASE WHEN p_size % 3 < 2 THEN p_name END AS name, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand END AS brand, CASE WHEN p_size % 3 = 0 THEN p_type END AS category, CASE WHEN p_size % 3 = 0 THEN p_size || '500' END AS price FROM part")
def h06(spark, d):
    ld = structured.structured_signals(structured.json_ld_texts(F.col("html")))
    return shop_pages(spark, d).select("page_id", ld.alias("ld")).select("page_id", *[F.col(f"ld.fact_{n}").alias(n) for n in ("name", "brand", "category", "price")])


@query("H07_product_signals", "SELECT p_partkey AS page_id, p_size % 3 = 0 AS has_product, CASE WHEN p_size % 3 = 0 THEN p_name END AS name, CASE WHEN p_size % 3 = 0 THEN p_brand || ' (KR)' END AS brand FROM part")
def h07(spark, d):
    ld = structured.structured_signals(structured.json_ld_texts(F.col("html")))
    return shop_pages(spark, d).select("page_id", ld.alias("ld")).select("page_id", "ld.has_product", "ld.name", "ld.brand")


@query("H08_names", f"{S.snapshot(_SHOP)} SELECT page_id, title, meta AS meta_description, product_name FROM snap")
def h08(spark, d):
    return pages.described(shop_pages(spark, d)).select("page_id", "title", "meta_description", "product_name")


@query("H15_shop_snapshot", f"{S.snapshot(_SHOP)} SELECT page_id, chars, confidence, sellability, array_to_string(tokens, '|') AS tokens, array_to_string(price, '|') AS price, array_to_string(blocker, '|') AS blocker FROM snap")
def h15s(spark, d):
    return pages.snapshot(shop_pages(spark, d)).select("page_id", F.col("chars").cast("long").alias("chars"), "confidence", "sellability", *[F.array_join(c, "|").alias(c) for c in ("tokens", "price", "blocker")])


@query("P01_shop_class", f"{S.classed(_SHOP)} SELECT page_id, page_class, supported FROM classed")
def p01s(spark, d):
    return pages.classified(shop_pages(spark, d)).select("page_id", "page_class", "supported")


_CLEANED = "CASE WHEN p_size % 2 = 0 THEN repeat('<p>cleaned text of it</p>', p_size) END"
_USED = "CASE WHEN length(cleaned) >= 60 THEN cleaned ELSE raw_text END"


@query("H16_preprocessed", f"{S.classed(_SHOP.replace(' FROM part', ', ' + S.visible('coalesce(' + _CLEANED + ', ' + chr(39) * 2 + ')') + ' AS cleaned FROM part'), text=_USED, brand=False, schema='payloads > 0')} SELECT page_id, chars, CASE WHEN length(cleaned) >= 60 THEN 'cleaned_html' ELSE 'raw_html' END AS text_source, page_class FROM classed")
def h16(spark, d):
    """A page and its cleaned form come from one row, so no page is sent for a join."""
    return pages.preprocessed_snapshot(shop_pages(spark, d, F.expr(_CLEANED).alias("cleaned_html"))).select("page_id", F.col("chars").cast("long").alias("chars"), "text_source", "page_class")


@query("P06_resolved", f"{S.classed(_SHOP)} SELECT coalesce(CASE WHEN NOT supported THEN page_class END, 'pack') AS outcome, count(*) AS pages FROM classed GROUP BY 1")
def p06(spark, d):
    packs, failures = resolve.resolve(shop_pages(spark, d))
    return packs.select(F.lit("pack").alias("outcome")).unionByName(failures.select(F.col("failure_code").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("pages"))


@query("E01_packs", f"{S.classed(_SHOP)} SELECT page_id, page_class, CASE WHEN ld_name IS NOT NULL THEN ld_name WHEN payloads > 0 THEN p.p_name ELSE og END AS product_name, sellability_state FROM classed JOIN part p ON p.p_partkey = page_id WHERE supported")
def e01(spark, d):
    packs, _ = resolve.resolve(shop_pages(spark, d))
    return packs.select("page_id", "page_class", "product_name", "sellability_state")


@query("E04_pack_facts", f"{S.classed(_SHOP)}, f AS (SELECT page_id, page_class, p_size, p_type, p_brand, url FROM classed JOIN part p ON p.p_partkey = page_id WHERE supported) SELECT page_id, CASE p_size % 3 WHEN 2 THEN CASE p_size % 4 WHEN 0 THEN 'Laneige' WHEN 1 THEN 'Example' WHEN 2 THEN NULL ELSE 'Example' END ELSE p_brand END AS brand, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'skincare' END AS category, CASE WHEN page_class IN {dims.SUPPORT_CLASSES!r} THEN NULL WHEN p_size % 3 = 0 THEN p_size || '500' WHEN p_size >= 10 THEN p_size || ',500' END AS price FROM f")
def e04(spark, d):
    packs, _ = resolve.resolve(shop_pages(spark, d))
    value = lambda k: interpret.first_value(F.col("facts"), k)
    return packs.select("page_id", value("brand").alias("brand"), value("product_category").alias("category"), value("price").alias("price"))


# -- evidence of texts: each input with what it must give

_TEXTS = ("Retinol 50ml 100 ml improves wrinkle, pore", "BEST SELLER cream mask serum", "순도 99% 레티놀 ceramide 케어", "ABC Complex technology 5D Hyaluronic Acid 30g", "GALAXY 5G PRO", "see www.x.com/a.html 12 gb processor supports gaming")
_SAID = {
    "E08_measures": ("50ml|100 ml", "", "", "30g", "5G", "12 gb"),
    "E09_benefits": ("Retinol 50ml 100 ml", "", "레티놀 ceramide", "", "", "html 12 gb processor"),
    "E10_ingredients": ("Retinol", "", "레티놀|ceramide", "5D Hyaluronic Acid", "", ""),
    "E10_technologies": ("", "", "", "Complex technology 5D|5D Hyaluronic Acid", "", ""),
}
_READ = {"E08_measures": evidence.measurements, "E09_benefits": evidence.benefits, "E10_ingredients": evidence.ingredients, "E10_technologies": evidence.technologies}


def _texted(name: str):
    @query(name, f"SELECT p_partkey, {_case(_SAID[name])} AS found FROM part")
    def run(spark, d):
        return _part(spark, d).select("p_partkey", F.array_join(_READ[name](_pick(_TEXTS)), "|").alias("found"))


for _name in _SAID:
    _texted(_name)


@query("E06_dropped_blocks", f"SELECT p_partkey, {_case((0, 1, 0, 0, 1, 1))} = 1 AS dropped FROM part")
def e06(spark, d):
    return _part(spark, d).select("p_partkey", evidence.dropped_block(_pick(_TEXTS), F.lit("Night Cream"), F.lit("Acme")).alias("dropped"))


@query("E07_semantic_facts", f"SELECT p_partkey, {_case(('volume:50ml,volume:100 ml,variant:50ml / 100 ml,benefit:Retinol 50ml 100 ml,key_ingredient:Retinol,volume:50ml,volume:100 ml', '', 'benefit:레티놀 ceramide,key_ingredient:레티놀,key_ingredient:ceramide', 'volume:30g,key_ingredient:5D Hyaluronic Acid,attribute:Complex technology 5D,attribute:5D Hyaluronic Acid,volume:30g', 'volume:5G,volume:5G', 'volume:12 gb,benefit:html 12 gb processor,volume:12 gb,attribute:processor'))} AS facts FROM part")
def e07(spark, d):
    made = evidence.semantic_facts(_pick(_TEXTS), F.lit("title"), F.lit(0.06))
    return _part(spark, d).select("p_partkey", F.array_join(F.transform(made, lambda f: F.concat_ws(":", f["type"], f["value"])), ",").alias("facts"))


@query("E05_text_entries", f"SELECT p_partkey, {_case(('decoded_text:1,decoded_fallback:2', 'decoded_fallback:2', 'decoded_text:1,decoded_fallback:2', 'decoded_text:1,decoded_fallback:2', 'decoded_fallback:2', 'decoded_fallback:2'))} AS sources FROM part")
def e05(spark, d):
    """Each page has one block, and a whole text of that block and one line more: too little, so the lines are read too."""
    block = _pick(_TEXTS)
    entries = evidence.text_entries(F.array(block), F.concat(block, F.lit("\n plain words about the item \n")), F.lit("Night Cream"), F.lit("Acme"))
    return _part(spark, d).select("p_partkey", F.array_join(F.transform(entries, lambda e: e["source"]), ",").alias("sources"))


_NAMES = (("Night Cream | Acme Official", "commerce_pdp"), ("Apple MacBook Pro 14 - Tech Specs - Apple Support", "support_spec_page"), ("Glow Serum Official Store", "commerce_pdp"), ("Widget One Two Three Four Five", "support_spec_page"), ("AirPods Pro 2 manual download", "document_download_heavy_support_page"), ("  - | ", "commerce_pdp"))


@query("E12_names", f"SELECT p_partkey, {_case(('Night Cream', 'MacBook Pro 14', 'Glow Serum', 'Widget One Two Three', 'AirPods Pro 2', None))} AS name FROM part")
def e12(spark, d):
    return _part(spark, d).select("p_partkey", evidence.canonical_name([_pick([n for n, _ in _NAMES])], _pick([c for _, c in _NAMES])).alias("name"))


@query("E11_brands", "SELECT page_id, CASE p_size % 3 WHEN 2 THEN CASE p_size % 4 WHEN 0 THEN 'Laneige' WHEN 2 THEN NULL ELSE 'Example' END ELSE p_brand END AS brand FROM (SELECT p_partkey AS page_id, * FROM part)")
def e11(spark, d):
    return evidence.with_context(pages.snapshot(shop_pages(spark, d))).select("page_id", F.col("fact_brand").alias("brand"))


_CATEGORIES = ((None, "Galaxy Buds earbuds", "commerce_pdp"), ("", "MacBook Air", "commerce_pdp"), (None, "Trail sneaker", "marketing_only_pdp"), ("https://x.com/c", "Sleeping Mask", "commerce_pdp"), (None, "Widget", "support_spec_page"), (None, "Widget", "commerce_pdp"), ("Face Cream", "Widget", "commerce_pdp"))


@query("E13_categories", f"SELECT p_partkey, {_case(('wireless earbuds', 'laptop', 'running shoes', 'skincare', 'electronics', None, 'Face Cream'))} AS category FROM part")
def e13(spark, d):
    stated, name, cls = (_pick([x[i] for x in _CATEGORIES]) for i in range(3))
    return _part(spark, d).select("p_partkey", evidence.category(stated, [name, F.lit(None).cast("string")], cls).alias("category"))


@query("E17_lifted_facts", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'benefit:soft skin' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN ',' ELSE '' END || 'usage:' || p_name ELSE '' END AS facts FROM part")
def e17(spark, d):
    even = F.when(F.col("p_size") % 2 == 0, "title").otherwise("nowhere")
    quote = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise("absent words")
    answer = lambda k, v, s, q: F.struct(F.lit(k).alias("type"), v.alias("value"), s.alias("source_field"), q.alias("source_quote"))
    answers = F.array(answer("benefit", F.lit("soft skin"), even, F.lit("Soft Skin")), answer("price", F.lit("1"), F.lit("title"), F.lit("soft")), answer("usage", F.col("p_name"), F.lit("decoded_text"), quote))
    sources = F.create_map(F.lit("title"), F.lit("for soft skin"), F.lit("decoded_text"), F.concat(F.lit("use "), "p_name"))
    return _part(spark, d).select("p_partkey", F.array_join(F.transform(evidence.lifted_facts(answers, sources), lambda f: F.concat_ws(":", f["type"], f["value"])), ",").alias("facts"))


# -- interpretation

_NAME = "concat('Night ', CASE p_size % 3 WHEN 0 THEN 'Cream' WHEN 1 THEN 'Mask' ELSE 'Widget' END, ' ', p_partkey)"


def product_packs(spark, d) -> DataFrame:
    """One pack for each part, with facts of every sort."""
    fact = lambda k, v, tags=(), tier="direct": F.struct(F.lit(k).alias("type"), v.alias("value"), F.lit("given").alias("source"), F.lit(tier).alias("tier"), texts(tags).alias("tags"), F.lit(0.9).alias("confidence"))
    lit = F.lit
    odd = F.col("p_size") % 2 == 1
    facts = F.array(
        fact("brand", lit("Acme")),
        fact("product_category", F.when(F.col("p_size") % 3 == 0, "스킨케어").otherwise("Face Care"), ("category",)),
        fact("volume", F.concat(F.col("p_size").cast("string"), lit("ml")), ("attribute",)),
        fact("volume", lit("70ml"), ("attribute",)),
        fact("key_ingredient", lit("Retinol"), ("attribute", "benefit")),
        fact("attribute", lit("AquaTox Complex"), ("attribute", "brand_technology")),
        fact("texture", lit("크림 제형")),
        fact("benefit", F.when(odd, "가성비 좋은 보습").otherwise("보습"), ("benefit",)),
        fact("concern", lit("건조"), ("problem_solution",)),
        fact("skin_type", lit("민감 피부"), ("audience",)),
        fact("usage", lit("야간"), ("use_case",)),
        fact("use_case", lit("민감 피부"), ("use_case", "audience")),
        fact("price", F.concat((F.col("p_size") * 1000).cast("string"), lit("원")), ("commerce",)),
        fact("award", F.when(odd, "Black Friday 1위").otherwise("1위"), ("social_proof",), "inferred"),
    )
    url = F.concat(lit("https://www.acme.com/products/"), F.col("p_partkey").cast("string"))
    return _part(spark, d).select("p_partkey", "p_size", url.alias("url"), F.expr(_NAME).alias("product_name"), lit("commerce_pdp").alias("page_class"), lit("sellable").alias("sellability_state"), lit("sufficient").alias("sufficiency"), facts.alias("facts"))


_KIND = "CASE p_size % 3 WHEN 0 THEN 'Cream' WHEN 1 THEN 'Mask' ELSE 'Widget' END"
#: Category terms of the packs: their facts name retinol, so the type is skincare; cream and mask add theirs.
_TERMS = {"Cream": ("레티놀 세럼", "레티놀 크림", "민감 피부 레티놀", "레티놀 스킨케어", "보습 크림", "장벽 크림", "페이스 크림"), "Mask": ("레티놀 세럼", "레티놀 크림", "민감 피부 레티놀", "레티놀 스킨케어", "보습 크림", "장벽 크림", "페이스 크림", "슬리핑 마스크", "보습 마스크", "수분 마스크")}


@query("I02_fact_picks", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN '가성비 좋은 보습|Black Friday 1위|Retinol' ELSE '보습|1위|Retinol' END AS benefits, '건조' AS concerns, '민감 피부' AS audience, '야간' AS usage FROM part")
def i02(spark, d):
    it = interpret.interpreted(product_packs(spark, d))
    return it.select("p_partkey", *[F.array_join(c, "|").alias(c) for c in ("benefits", "concerns", "audience", "usage")])


@query("I03_facets", "SELECT p_partkey, CASE WHEN p_size = 70 THEN '70ml' ELSE p_size || 'ml|70ml' END AS specs, 'Retinol' AS ingredients, 'AquaTox Complex' AS technology, '크림 제형' AS form_factors FROM part")
def i03(spark, d):
    it = interpret.interpreted(product_packs(spark, d))
    return it.select("p_partkey", *[F.array_join(c, "|").alias(c) for c in ("specs", "ingredients", "technology", "form_factors")])


@query("I06_category_terms", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '" + "|".join(dict.fromkeys([*_TERMS["Cream"]])) + "' WHEN p_size % 3 = 1 THEN '레티놀 세럼|레티놀 크림|민감 피부 레티놀|레티놀 스킨케어|보습 크림|장벽 크림|페이스 크림|슬리핑 마스크|보습 마스크|수분 마스크' ELSE '" + "|".join(_TERMS["Cream"]) + "' END AS terms FROM part")
def i06(spark, d):
    """The texture fact says "크림", so the cream terms are there for all; the mask terms come with the name."""
    return interpret.interpreted(product_packs(spark, d)).select("p_partkey", F.array_join("category_terms", "|").alias("terms"))


@query("I04_categories", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '레티놀 크림' ELSE 'Face Care' END AS category, CASE WHEN p_size % 3 = 0 THEN '보습 크림|장벽 크림|페이스 크림' ELSE '' END AS secondary FROM part")
def i04(spark, d):
    """A broad category gives way to the term with the best evidence: "크림" stands in the facts, so the first term with that head wins."""
    return interpret.interpreted(product_packs(spark, d)).select("p_partkey", "category", F.array_join("secondary", "|").alias("secondary"))


@query("I10_text_probes", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN '가성비' ELSE '' END AS value_terms, '' AS events, CASE WHEN p_size = 70 THEN '70ml' ELSE p_size || 'ml|70ml' END AS measures, p_size <> 70 AS price_compared FROM part")
def i10(spark, d):
    it = interpret.interpreted(product_packs(spark, d))
    return it.select("p_partkey", *[F.array_join(c, "|").alias(c) for c in ("value_terms", "events", "measures")], "price_compared")


@query("I11_band_phrases", "SELECT p_partkey, CASE WHEN p_size < 10 THEN '' WHEN p_size % 3 = 0 THEN floor(p_size / 10)::INT || '만원대 레티놀 크림|' || floor(p_size / 10)::INT || '만원대 보습 크림|' || floor(p_size / 10)::INT || '0,000원대 레티놀 크림|' || floor(p_size / 10)::INT || '0,000원대 보습 크림' ELSE floor(p_size / 10)::INT || '만원대 Face Care|' || floor(p_size / 10)::INT || '0,000원대 Face Care' END AS bands FROM part")
def i11b(spark, d):
    return interpret.interpreted(product_packs(spark, d)).select("p_partkey", F.array_join("bands", "|").alias("bands"))


@query("I01_interpretation", f"SELECT p_partkey, {_NAME} AS name, 'Acme' AS brand, 'skincare' AS types, {_NAME} || '|Acme|Acme ' || CASE WHEN p_size % 3 = 0 THEN '레티놀 크림|Acme 보습 크림' ELSE 'Face Care' END AS aliases, '건조 ' || CASE WHEN p_size % 3 = 0 THEN '레티놀 크림' ELSE 'Face Care' END AS problem_phrases, true AS price_allowed FROM part")
def i01(spark, d):
    it = interpret.interpreted(product_packs(spark, d))
    return it.select("p_partkey", "name", "brand", *[F.array_join(c, "|").alias(c) for c in ("types", "aliases", "problem_phrases")], "price_allowed")


@query("I08_taxonomy_terms", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '중고|샘플|도매|공병|원료|만들기|재판매|OEM' WHEN 1 THEN '중고|리퍼|수리' ELSE '중고|도매|재판매' END AS negatives, CASE p_size % 3 WHEN 0 THEN '야간 케어|데일리 루틴|건조한 날씨|겨울 보습|입문용|일상용' ELSE '입문용|일상용' END AS seasons FROM part")
def i08(spark, d):
    types = F.array(_pick(("skincare", "audio", "general"), "p_size"))
    return _part(spark, d).select("p_partkey", F.array_join(interpret.terms_for(types, "negative_seed"), "|").alias("negatives"), F.array_join(interpret.terms_for(types, "season_event"), "|").alias("seasons"))


# -- bank, plans, picks


def _banked(spark, d) -> DataFrame:
    return bank.with_bank(interpret.interpreted(product_packs(spark, d)))


_C = "CASE WHEN p_size % 3 = 0 THEN '레티놀 크림' ELSE 'Face Care' END"
_BANK = {
    "brand": f"'Acme|Acme ' || {_C} || CASE WHEN p_size % 3 = 0 THEN '|Acme 보습 크림|Acme 장벽 크림|Acme 페이스 크림|Night 레티놀 크림|Night 보습 크림|Night 장벽 크림|Night 페이스 크림' ELSE '|Night Face Care' END",
    "feature_attribute": f"{_NAME} || ' ' || p_size || 'ml' || CASE WHEN p_size = 70 THEN '' ELSE '|' || {_NAME} || ' 70ml' END",
    "problem_solution": "CASE WHEN p_size % 3 = 0 THEN '건조 크림|건조 레티놀 크림' ELSE '건조 Care|건조 Face Care' END",
    "competitor_comparison": f"'이니스프리 ' || {_C} || '|메디힐 ' || {_C} || '|닥터자르트 ' || {_C} || '|에스트라 ' || {_C}",
    "benefit_price": f"{_NAME} || ' 가격|' || {_C} || ' 가격' || CASE WHEN p_size % 2 = 1 THEN '|' || {_NAME} || ' 가성비|' || {_C} || ' 가성비' ELSE '' END",
}


@query("G06_phrase_bank", " UNION ALL ".join(f"SELECT p_partkey, {Q(c)} AS category, {v} AS phrases FROM part" for c, v in _BANK.items()))
def g06(spark, d):
    """Of a comparison and the same with "비교" at its end the first stays: their signatures are equal."""
    said = lambda c: F.struct(F.lit(c).alias("category"), F.array_join(F.transform(F.filter("bank", lambda e: e["category"] == c), lambda e: e["keyword"]), "|").alias("phrases"))
    return rows_of(_banked(spark, d), F.array(*map(said, _BANK)), "p_partkey").select("p_partkey", "x.*")


@query("G07_weak_budget")
def g07(spark, d):
    """Tiers of problem phrases where thin evidence was filled up: the first twenty are weak."""
    packs = product_packs(spark, d).withColumn("weak_backfill_used", F.lit(True))
    banked = bank.with_bank(interpret.interpreted(packs))
    return rows_of(banked, F.filter("bank", lambda e: e["category"] == "problem_solution"), "p_partkey", place="place").groupBy("x.tier").agg(F.count("*").alias("n"), F.max("place").alias("last"))


@query("G08_padded_bank")
def g08(spark, d):
    return rows_of(_banked(spark, d), F.col("bank"), "p_partkey").where(F.col("x.reason").endswith("supplementation pool")).groupBy("x.category").agg(F.count("*").alias("n"))


@query("G09_picks")
def g09(spark, d):
    banked = written(_banked(spark, d))
    return bank.selected(banked, bank.category_plan(banked, F.lit(30))).select("url", "ord", "category", "keyword")


@query("G10_intents")
def g10(spark, d):
    banked = written(_banked(spark, d))
    return bank.intents(banked, bank.category_plan(banked, F.lit(30)))


_PLANNED = "SELECT url, category, seats FROM (SELECT 'https://www.acme.com/products/' || p_partkey AS url, unnest([" + ", ".join(f"{{'category': {Q(c)}, 'seats': {t}}}" for c, t in dims.CATEGORY_TARGETS.items()) + "], recursive := true) FROM part)"


def _plan(spark, d) -> DataFrame:
    seats = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("seats")) for c, t in dims.CATEGORY_TARGETS.items()])
    return rows_of(product_packs(spark, d), seats, "url").select("url", "x.*")


@query("G04_slot_plan", "SELECT 'https://www.acme.com/products/' || p_partkey AS url, x.c AS category, x.s AS slot_type, x.t::BIGINT AS target, x.r AS required FROM (SELECT p_partkey, unnest([{'c': 'generic_category', 's': 'generic_type_phrase', 't': 12, 'r': true}, {'c': 'problem_solution', 's': 'problem_noun_phrase', 't': 12, 'r': true}, {'c': 'competitor_comparison', 's': 'competitor_brand_type', 't': 8, 'r': true}, {'c': 'negative', 's': 'negative_exclusion', 't': 1, 'r': true}, {'c': 'season_event', 's': 'seasonal_context', 't': 6, 'r': true}]) AS x FROM part)")
def g04(spark, d):
    """Categories with one slot that has seeds get all their seats there."""
    made = bank.slot_plan(written(interpret.interpreted(product_packs(spark, d))), _plan(spark, d))
    return made.where(F.col("category").isin("generic_category", "problem_solution", "competitor_comparison", "negative", "season_event")).select("url", "category", "slot_type", "target", "required")


@query("G11_weak_batches", f"{S.ROWS}, p AS (SELECT DISTINCT url FROM r), goal(category, target) AS (VALUES {', '.join(f'({Q(c)}, {t})' for c, t in {**dims.CATEGORY_TARGETS, dims.NEGATIVE: 1}.items())}), n AS (SELECT url, category, count(*) AS n FROM r GROUP BY ALL), j AS (SELECT p.url, 'category_' || goal.category AS batch, goal.category, coalesce(n.n, 0) AS n, greatest(1, floor(goal.target * 0.35::DOUBLE))::BIGINT AS least FROM p CROSS JOIN goal LEFT JOIN n ON n.url = p.url AND n.category = goal.category) SELECT *, n = 0 AS missing, n < least AS low_volume FROM j WHERE n < least")
def g11(spark, d):
    r = candidate_rows(spark, d)
    seats = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("seats")) for c, t in dims.CATEGORY_TARGETS.items()])
    plan = rows_of(r.select("url").distinct(), seats, "url").select("url", "x.*")
    return bank.weak_batches(bank.batch_plan(plan), r)


@query("G12_generated")
def g12(spark, d):
    chosen, _ = intents.generate(product_packs(spark, d))
    return chosen.select("url", "ord", "category", "keyword", "naver_match", "google_match", "slot_type", "score", "place")


# -- predicates of rows


@query("F06_domain_mismatch", f"{S.ROWS} SELECT url, ord, kind = 'skincare' AND {S.has_any('keyword', dims.SKINCARE_BLOCKED)} AS mismatch FROM (SELECT * REPLACE (keyword || CASE WHEN ord % 3 = 0 THEN ' 라인업' ELSE '' END AS keyword) FROM r)")
def f06(spark, d):
    r = candidate_rows(spark, d).withColumn("keyword", F.concat("keyword", F.when(F.col("ord") % 3 == 0, " 라인업").otherwise("")))
    return r.select("url", "ord", product.domain_mismatch(F.col("keyword"), F.col("types")).alias("mismatch"))


@query("F08_allowed_negatives", f"{S.ROWS} SELECT url, ord, keyword IN {S.ALLOWED} OR (starts_with(keyword, product_name || ' ') AND trim(substr(keyword, length(product_name) + 1)) IN {S.ALLOWED}) AS allowed FROM r")
def f08(spark, d):
    return candidate_rows(spark, d).select("url", "ord", rows.allowed_negative(F.col("keyword"), F.col("product_name"), F.col("types")).alias("allowed"))


_RIVAL_KW = "CASE ord % 4 WHEN 0 THEN 'Brand#3 economy' WHEN 1 THEN 'brand#7 ' || product_name || ' 비교' WHEN 2 THEN 'Brand#11 용량 비교 small' ELSE 'Brand#3 50 ml small' END"


@query("F09_competitors", f"{S.ROWS}, x AS (SELECT url, ord, brand, product_name, {_RIVAL_KW} AS kw FROM r), y AS (SELECT *, {S.tok('kw', S.K.POLICY_TOKEN)} AS t FROM x) SELECT url, ord, {S.RIVAL} AS valid FROM y")
def f09(spark, d):
    r = candidate_rows(spark, d).withColumn("kw", F.expr(_RIVAL_KW))
    return r.select("url", "ord", product.valid_competitor(F.col("kw"), F.col("competitors"), F.col("identity"), F.col("category_terms"), F.col("types")).alias("valid"))


#: Keywords by category with the code that each must get, for a product "Acme Pen" of the category "태블릿 펜".
_SURFACES = (
    ("purchase_intent", "Acme Pen 구매처", "surface_scaffold"),
    ("brand", "Acme Pen 메모", "surface_product_action"),
    ("brand", "Acme Pen 사용법", "surface_informational"),
    ("purchase_intent", "Acme Pen shop", "surface_purchase_suffix"),
    ("long_tail", "베스트셀러 펜", "surface_merchandising"),
    ("feature_attribute", "펜 장점", "surface_feature_scaffold"),
    ("feature_attribute", "Acme Pen 128gb", "surface_product_prefix"),
    ("feature_attribute", "Acme Pen 12g", None),
    ("feature_attribute", "알루미늄 펜", "surface_ungrounded_feature"),
    ("benefit_price", "싼 펜", "surface_price_shape"),
    ("benefit_price", "펜 가격 149,000원", "surface_raw_price"),
    ("benefit_price", "3만원대 펜", None),
    ("season_event", "Acme Pen 겨울", "surface_product_prefix"),
    ("season_event", "데일리 루틴 펜", "surface_season_scaffold"),
    ("season_event", "black friday 펜", "surface_unsupported_event"),
    ("season_event", "겨울 펜", "surface_ungrounded_season"),
    ("season_event", "필기 펜", None),
    ("brand", "Acme Pen 태블릿 펜", "surface_product_prefix"),
    ("brand", "Acme Pen 장벽", "surface_product_purpose_suffix"),
    ("purchase_intent", "Acme Pen 2세대", None),
    ("long_tail", "Acme Pen 흰색", "surface_product_prefix"),
    ("problem_solution", "미끄럼 펜", "surface_ungrounded_problem"),
    ("problem_solution", "손목 통증 펜", None),
    ("brand", "Acme Pen 그림용", "surface_product_purpose_suffix"),
    ("competitor_comparison", "와콤 대체 펜", "surface_competitor_shape"),
    ("competitor_comparison", "와콤 펜", None),
)


def _surface_rows(spark, d) -> DataFrame:
    it = {"name": F.lit("Acme Pen"), "product_category": F.lit("태블릿 펜"), "secondary": none(), "audience": none(), "concerns": texts(("손목 통증",)), "usage": texts(("필기",)), "page_class": F.lit("commerce_pdp"), "events": none(), "measures": texts(("12g",)), "specs": texts(("12g",)), "ingredients": none(), "technology": none(), "form_factors": none()}
    category, keyword = (_pick([x[i] for x in _SURFACES]) for i in range(2))
    return _part(spark, d).select(F.col("p_partkey").alias("url"), category.alias("category"), keyword.alias("keyword"), F.lit("s").alias("slot_type"), *[c.alias(n) for n, c in it.items()])


@query("F11_surface_codes", f"SELECT p_partkey AS url, {_case([c for _, _, c in _SURFACES])} AS surface FROM part")
def f11(spark, d):
    return surface.with_surface(_surface_rows(spark, d)).select("url", "surface")


@query("F12_surface_cleanup", f"SELECT coalesce(code, 'kept') AS outcome, count(*) AS n FROM (SELECT CASE WHEN c IN {dims.HARD_SURFACES!r} THEN c END AS code FROM (SELECT {_case([c for _, _, c in _SURFACES])} AS c FROM part)) GROUP BY 1")
def f12(spark, d):
    kept, dropped = surface.cleaned(_surface_rows(spark, d))
    both = kept.select(F.lit("kept").alias("outcome")).unionByName(dropped.select(F.col("drop_reason_code").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query("F13_missing_heads", "SELECT p_partkey AS url, x AS keyword, i - 1 AS ord FROM (SELECT p_partkey, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ['크림', '보습 마스크'] WHEN 1 THEN ['크림'] ELSE []::VARCHAR[] END AS h FROM part))")
def f13(spark, d):
    """Heads "크림" and "보습 마스크" are lost though longer wordings stayed; "세럼" has none, "Acme 크림" is branded, and a third head is one too many."""
    stayed = F.when(F.col("p_size") % 3 == 0, texts(("장벽 크림", "수분 보습 마스크", "민감 피부 토너"))).when(F.col("p_size") % 3 == 1, texts(("장벽 크림",))).otherwise(texts(("크림", "장벽 크림")))
    heads = ("크림", "세럼", "Acme 크림", "보습 마스크", "토너")
    one = _part(spark, d).select(F.col("p_partkey").alias("url"), F.lit("Acme Night").alias("name"), F.lit("Acme").alias("brand"), F.lit("Night").alias("short"), texts(heads).alias("category_terms"), stayed.alias("generic"), texts(heads).alias("sources"))
    return surface.missing_heads(one)


# -- recognised text

_BLOCKS = ("", "12345 678 90", "acme acme acme", "words that stand on the page already", "kr", "Zeta Omega Kappa speakers are very nice and loud", "big sale event for everyone in the whole town today", "Acme Pen 12 g 용량", "제조국 한국", "Acme Pen spec compare size 12 g and 30 cm")
_REASONS = ("empty_text", "mostly_numeric_junk", "brand_only_repetition", "duplicate_of_direct_html", "too_short_without_product_tokens", "unrelated_product_names", "promo_not_tied_to_product", None, None, None)


def _blocks(spark, d, source: str = "page") -> tuple[DataFrame, DataFrame]:
    p = _part(spark, d)
    blocks = p.select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("ord"), _pick(_BLOCKS).alias("text"), F.lit(source).alias("source"), F.concat(F.lit("i"), (F.col("p_partkey") % 7).cast("string")).alias("image_src"), F.when(F.col("p_size") % 2 == 0, "table_like_image").otherwise("general_detail_image").alias("candidate_type"), F.lit("plain_text").alias("pipeline_type"), F.lit("original").alias("preprocessing_variant"), F.lit("none").alias("tile_mode"), F.lit(0).alias("tile_index"), F.lit(0).alias("block_order"))
    own = p.select(F.col("p_partkey").alias("page_id"), F.lit("Acme Pen").alias("product_name"), texts(("Acme",)).alias("tokens"), F.lit("Here are words that stand on the page already.").alias("text"), F.lit("commerce_pdp").alias("page_class"))
    return blocks, own


@query("O06_admission", f"SELECT p_partkey AS page_id, CASE WHEN p_partkey % {len(_BLOCKS)} = 6 THEN 'unrelated_product_names' ELSE {_case(_REASONS)} END AS rejected FROM part")
def o06(spark, d):
    """Latin words that are not the product's count as names of others, so the promotion is turned down for them first."""
    return recognised.judged(*_blocks(spark, d)).select("page_id", "rejected")


@query("O06_scores", "SELECT p_partkey AS page_id, CASE p_partkey % 10 WHEN 7 THEN round_even(16 / 120.0::DOUBLE + 0.28::DOUBLE + 0.12::DOUBLE, 4) WHEN 8 THEN round_even(6 / 120.0::DOUBLE, 4) END AS text_quality, CASE p_partkey % 10 WHEN 7 THEN 1.0::DOUBLE WHEN 8 THEN CASE WHEN p_size % 2 = 0 THEN 0.42::DOUBLE ELSE 0.36::DOUBLE END END AS same_product, CASE WHEN p_size % 2 = 0 THEN 0.85::DOUBLE ELSE 0.66::DOUBLE END AS layout_trust FROM part WHERE p_partkey % 10 IN (7, 8)")
def o06s(spark, d):
    out = recognised.judged(*_blocks(spark, d))
    return out.where("page_id % 10 in (7, 8)").select("page_id", "text_quality", F.bround("same_product", 2).alias("same_product"), "layout_trust")


@query("O07_direct", "SELECT p_partkey AS page_id, CASE p_partkey % 10 WHEN 7 THEN true WHEN 8 THEN false WHEN 9 THEN true ELSE false END AS direct FROM part")
def o07(spark, d):
    return recognised.judged(*_blocks(spark, d)).select("page_id", "direct")


@query("O09_direct_candidates", "SELECT p_partkey AS page_id, 'ocr_direct_001' AS candidate_id FROM part WHERE p_partkey % 10 IN (7, 9)")
def o09(spark, d):
    admitted = recognised.judged(*_blocks(spark, d)).where("rejected is null")
    return recognised.direct_candidates(recognised.line_groups(admitted)).select("page_id", "candidate_id")


@query("O10_block_counts", "SELECT p_partkey AS page_id, 'i' || p_partkey % 7 AS image_src, CASE WHEN p_partkey % 10 >= 7 THEN 1 ELSE 0 END::BIGINT AS admitted, CASE WHEN p_partkey % 10 < 7 THEN 1 ELSE 0 END::BIGINT AS rejected, CASE WHEN p_partkey % 10 >= 7 THEN 1 ELSE 0 END::BIGINT AS line_groups, CASE WHEN p_partkey % 10 IN (7, 9) THEN 1 ELSE 0 END::BIGINT AS direct_candidates FROM part")
def o10(spark, d):
    judged = recognised.judged(*_blocks(spark, d))
    groups = recognised.line_groups(judged.where("rejected is null"))
    return recognised.block_counts(judged, groups, recognised.direct_candidates(groups)).drop("mean_same_product")


@query("O11_decisions", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 'SKIPPED' ELSE 'AVAILABLE' END AS status, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'thin_visible_text|no_ocr_blocks_available' ELSE 'ocr_not_required' END WHEN p_size % 2 = 0 THEN 'thin_visible_text' ELSE 'fixture_ocr_blocks_present' END AS reasons FROM part")
def o11(spark, d):
    blocks, own = _blocks(spark, d)
    judged = recognised.judged(blocks.where("page_id % 3 != 0"), own)
    asked = _part(spark, d).select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_size") % 2 == 0, texts(("thin_visible_text",))).otherwise(none()).alias("reasons"))
    out = recognised.decisions(asked, judged, recognised.direct_candidates(recognised.line_groups(judged.where("rejected is null"))))
    return out.select("page_id", "status", F.array_join("reasons", "|").alias("reasons"))


@query("O05_image_results", "SELECT p_partkey AS page_id, 's' || p_partkey AS image_src, CASE WHEN p_size % 2 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS raw_block_count, CASE WHEN p_size % 2 = 0 THEN 'src' ELSE 'data-src' END AS image_attribute FROM part")
def o05(spark, d):
    p = _part(spark, d)
    ranked = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("src"), F.lit("data-src").alias("attribute"), F.lit("table_like_image").alias("candidate_type"))
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    done = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("image_src"), F.lit("src").alias("image_attribute"), null("string", "candidate_type"), null("string", "engine_used"), F.lit(0).alias("tile_count"), F.lit("completed").alias("status"), F.col("p_size").alias("raw_block_count"), null("int", "raw_char_count"), null("int", "runtime_ms"), null("string", "error"))
    return recognised.image_results(ranked, done).select("page_id", "image_src", "status", "raw_block_count", "image_attribute")


@query("O12_passes", f"SELECT p_partkey, {_case(('structured_table/original/korean/none,plain_text/enhance_contrast/korean/none', 'plain_text/original/korean/vertical,plain_text/enhance_contrast/korean/vertical,plain_text/original/en/vertical', 'plain_text/original/korean/none,plain_text/enhance_contrast/korean/none,plain_text/upscale_x2/korean/none', 'plain_text/original/korean/none,plain_text/enhance_contrast/korean/none,plain_text/original/en/none'))} AS passes FROM part")
def o12(spark, d):
    kind = _pick(("table_like_image", "long_detail_banner", "front_label_closeup", "general_detail_image"))
    pipe = F.when(kind == "table_like_image", "structured_table").otherwise("plain_text")
    made = recognised.planned_passes(kind, pipe, F.lit("https://x.com/a.jpg"), F.when(kind == "front_label_closeup", "제품 라벨").otherwise("label"), structured=True, languages=True)
    return _part(spark, d).select("p_partkey", F.array_join(F.transform(made, lambda p: F.concat_ws("/", p["pipeline_type"], p["preprocessing_variant"], p["ocr_lang"], p["tile_mode"])), ",").alias("passes"))


@query("O13_best_pass", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 0 WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS best FROM part")
def o13(spark, d):
    """The first pass reads three characters a size unit, and 120 are enough; the second reads one more, or fails."""
    one = lambda ok, chars, ms: F.struct(ok.alias("engine_ok"), chars.alias("char_count"), F.lit(1).alias("block_count"), F.lit("plain_text").alias("pipeline_type"), F.lit(ms).alias("runtime_ms"))
    size = F.col("p_size") * 3
    passes = F.array(one(F.lit(True), size, 9), one(F.col("p_size") % 2 == 0, size + 1, 5), one(F.lit(True), size, 10))
    return _part(spark, d).select("p_partkey", recognised.best_pass(passes, F.lit("general_detail_image")).alias("best"))


# -- intents, answers, reports


@query("R02_rendered_intents", "WITH x AS (SELECT p_partkey, p_name, p_size % 5 AS k FROM part) SELECT p_partkey::VARCHAR AS url, p_name AS keyword, '완전일치' AS naver_match, 'exact' AS google_match FROM x WHERE k = 0 UNION ALL SELECT p_partkey::VARCHAR, p_name || ' n', '확장소재', '' FROM x WHERE k IN (1, 2) UNION ALL SELECT p_partkey::VARCHAR, p_name || ' g', '', 'phrase' FROM x WHERE k = 1 UNION ALL SELECT p_partkey::VARCHAR, p_name, '', 'exact' FROM x WHERE k = 3")
def r02i(spark, d):
    """By size: a shared render alone, two that differ, one for a single platform, a shared one for one platform only, and one that is not admitted."""
    k, name = F.col("p_size") % 5, F.col("p_name")
    share = F.when(k.isin(0, 3, 4), F.struct(name.alias("keyword"), (k != 4).alias("admitted")))
    side = lambda when, end, label: F.when(when, F.struct(F.concat(name, F.lit(end)).alias("keyword"), F.lit(label).alias("match_label"), F.lit(True).alias("admitted")))
    made = _part(spark, d).select(F.col("p_partkey").cast("string").alias("url"), F.lit(0).alias("ord"), F.lit("brand").alias("category"), F.lit("").alias("reason"), F.when(k == 3, texts(("google_sa",))).alias("allowed_platforms"), share.alias("shared"), side(k.isin(1, 2), " n", "확장소재").alias("naver"), side(k == 1, " g", "phrase").alias("google"))
    return intents.rendered(made).select("url", "keyword", "naver_match", "google_match")


_ANSWER = """concat(CASE WHEN p_size % 2 = 0 THEN '```json ' ELSE 'Sure: ' END, '{"data":{"items":[{"category":"brand","keyword":"', p_name, '","reason":"r"},{"category":"brand","keyword":""},{"category":"long_tail","intent_text":"', p_type, ' x"}]}}', CASE WHEN p_size % 2 = 0 THEN ' ```' ELSE ' done' END)"""


@query("R04_parsed_answers", "SELECT p_partkey, x.c AS category, x.k AS keyword, substr(sha1(x.c || '|' || x.k), 1, 16) AS intent_id FROM (SELECT p_partkey, unnest([{'c': 'brand', 'k': p_name}, {'c': 'long_tail', 'k': p_type || ' x'}]) AS x FROM part)")
def r04(spark, d):
    answers = _part(spark, d).select("p_partkey", F.expr(_ANSWER).alias("answer"))
    return responses.parsed_rows(answers).select("p_partkey", "category", "keyword", "intent_id")


@query("D06_debug_rows", f"{S.ROWS} SELECT url, ord, category, keyword, coalesce(reason, '') AS reason FROM r")
def d06(spark, d):
    made = candidate_rows(spark, d).withColumn("slot_type", F.lit(None).cast("string")).select("url", "ord", reports.as_json(reports.ROW_FIELDS).alias("j"))
    field = lambda n: F.get_json_object("j", f"$.{n}").alias(n)
    return made.select("url", "ord", field("category"), field("keyword"), F.coalesce(field("reason"), F.lit("")).alias("reason"))


_RUNS = "SELECT p_partkey AS case_id, s AS candidate_source, CASE WHEN s = 'markdown' AND p_size % 5 = 0 THEN 'non_product_page' ELSE 'commerce_pdp' END AS page_class, NOT (s = 'markdown' AND p_size % 5 = 0) AS supported, p_size * 10 + CASE s WHEN 'cleaned_html' THEN p_size % 3 WHEN 'fit_markdown' THEN 1 ELSE 0 END AS chars, CASE WHEN s = 'cleaned_html' AND p_size % 4 = 0 THEN 2 ELSE 6 END AS blocks, CASE WHEN s = 'fit_markdown' THEN 4 + p_size % 3 ELSE 5 END AS facts FROM part, (VALUES ('raw_html'), ('cleaned_html'), ('markdown'), ('fit_markdown')) v(s)"
_FLAGGED = f"WITH x AS ({_RUNS}), b AS (SELECT * FROM x WHERE candidate_source = 'raw_html'), f AS (SELECT x.*, CASE WHEN x.page_class <> b.page_class OR x.supported <> b.supported OR x.blocks * 2 < b.blocks THEN 'reject' WHEN x.candidate_source = 'fit_markdown' AND x.facts <= b.facts THEN 'keep_testing' WHEN x.chars > b.chars THEN 'candidate' ELSE 'keep_testing' END AS flag, x.facts <> b.facts AS changed FROM x JOIN b ON b.case_id = x.case_id)"


def _runs(spark, d) -> DataFrame:
    p, s = _part(spark, d), F.col("s")
    bad = (s == "markdown") & (F.col("p_size") % 5 == 0)
    every = p.select("p_partkey", "p_size", F.explode(texts(("raw_html", "cleaned_html", "markdown", "fit_markdown"))).alias("s"))
    return every.select(F.col("p_partkey").alias("case_id"), s.alias("candidate_source"), F.when(bad, "non_product_page").otherwise("commerce_pdp").alias("page_class"), (~bad).alias("supported"), (F.col("p_size") * 10 + F.when(s == "cleaned_html", F.col("p_size") % 3).when(s == "fit_markdown", 1).otherwise(0)).alias("chars"), F.when((s == "cleaned_html") & (F.col("p_size") % 4 == 0), 2).otherwise(6).alias("blocks"), F.when(s == "fit_markdown", F.col("p_size") % 3 + 4).otherwise(5).alias("facts"))


@query("A16_source_flags", f"{_FLAGGED} SELECT case_id, candidate_source, flag FROM f")
def a16(spark, d):
    return reports.recommendation(_runs(spark, d)).select("case_id", "candidate_source", "flag")


@query("A16_best_sources", f"{_FLAGGED} SELECT case_id, candidate_source, flag FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE flag WHEN 'candidate' THEN 2 WHEN 'keep_testing' THEN 1 ELSE 0 END DESC, chars DESC, candidate_source) AS t FROM f) WHERE t = 1")
def a16b(spark, d):
    return reports.best_sources(reports.recommendation(_runs(spark, d))).select("case_id", "candidate_source", "flag")


@query("A08_deviation", f"{S.ISSUES}, {S._SIDES}, n AS (SELECT url, platform, count(*) FILTER (category <> 'negative') AS total, " + ", ".join(f"count(*) FILTER (category = {Q(c)}) AS n_{c}" for c in dims.IDEAL_SHARES) + " FROM sides GROUP BY url, platform) SELECT url, platform, (0.0::DOUBLE + " + " + ".join(f"abs(n_{c}::DOUBLE / total - {v}::DOUBLE)" for c, v in dims.IDEAL_SHARES.items()) + ") / 9 AS deviation FROM n")
def a08(spark, d):
    return rows.url_metrics(candidate_rows(spark, d)).select("url", "platform", "deviation")


@query("A14_policy_drops", f"{S.ISSUES} SELECT url, keyword, category, 's' || ord AS slot_type, unnest(hard) AS drop_reason_detail FROM iss WHERE len(hard) > 0")
def a14p(spark, d):
    """Every row is its own intent; equal ones take the slot of the first."""
    r = rows.with_issues(candidate_rows(spark, d))
    known = r.select("url", "ord", "category", "keyword", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("slot_type"))
    return reports.policy_drops(r, known).select("url", "keyword", "category", "slot_type", "drop_reason_detail")


# -- sources


_SNAPSHOT_SQL = (
    "SELECT 'https://x.com/' || p_partkey AS raw_url, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Fact ' || p_name END AS product_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS title, 0::BIGINT AS n_blocks, false AS quality_warning, "
    "CASE WHEN p_size % 2 = 0 THEN 'fallback' END AS fallback_reason, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR || '|sold out' ELSE '' END AS stock, CASE WHEN p_size % 2 = 0 THEN p_size / 100::DOUBLE END AS ko, "
    "CASE WHEN p_size % 2 = 0 THEN p_size END AS width, CASE WHEN p_size % 2 = 0 THEN 'ocr ' || p_name END AS recognised, CASE WHEN p_size % 2 = 0 THEN 'paddle' END AS engine, CASE WHEN p_size % 2 = 0 THEN p_brand END AS ld_brand FROM part"
)


@query("S03_snapshots", _SNAPSHOT_SQL)
def s03(spark, d):
    """Half of the snapshots hold signals, scores, images, recognised text and structured data; the others none."""
    rich = """concat(',"product_name":"', p_name, '","fallback_reason":" fallback ","stock_signals":["', p_size, '","sold out"],"language_scores":{"ko":', p_size / 100D, '},"image_candidates":[{"src":"a.jpg","width":', p_size, '}],"ocr_text_blocks":[{"text":"ocr ', p_name, '","block_order":0}],"ocr_image_results":[{"image_src":"a.jpg","ocr_passes":[{"engine_used":"paddle","engine_ok":true}]}],"structured_data":[{"@type":"Product","brand":{"name":"', p_brand, '"}}]')"""
    payload = F.expr(f"""concat('{{"canonical_url":"https://x.com/', p_partkey, '","title":"', CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_type END, '","page_class":"commerce_pdp","_test_notes":"n"', CASE WHEN p_size % 2 = 0 THEN {rich} ELSE concat(',"facts":[{{"type":"brand","value":"b"}},{{"type":"product_name","value":"Fact ', p_name, '"}}]') END, '}}')""")
    out = files.snapshot_rows(_part(spark, d).select(payload.alias("payload")))
    first = lambda c: F.get(F.col(c), F.lit(0))
    return out.select(
        *("raw_url", "product_name", "title", F.size("visible_text_blocks").cast("long").alias("n_blocks"), "quality_warning", "fallback_reason", F.array_join("stock_signals", "|").alias("stock")),
        F.try_element_at("language_scores", F.lit("ko")).alias("ko"),
        first("image_candidates")["width"].alias("width"),
        first("ocr_text_blocks")["text"].alias("recognised"),
        F.get(first("ocr_image_results")["ocr_passes"], F.lit(0))["engine_used"].alias("engine"),
        F.try_variant_get(first("structured_data"), "$.brand.name", "string").alias("ld_brand"),
    )


@query("S04_decoded", "SELECT doc_id, md5(coalesce(text, '')) AS digest, 'utf-8' AS charset FROM documents")
def s04(spark, d):
    docs = _t(spark, d, "documents")  # before the function is made, which remembers where workers find this package
    body = structured.decode_body(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit("text/html"))
    return docs.select("doc_id", body.alias("b")).select("doc_id", F.md5("b.text").alias("digest"), "b.charset")


@query("S05_taxonomies", "SELECT * FROM (VALUES " + ", ".join(f"({Q(g)}, {len(t)}::BIGINT, {sum(map(len, t.values()))}::BIGINT)" for g, t in dims.TAXONOMIES.items()) + ") v(taxonomy, terms, types)")
def s05(spark, d):
    return files.taxonomies(spark).groupBy("taxonomy").agg(F.count("*").alias("terms"), F.sum(F.size("allowed_product_types")).alias("types"))


@query("S07_golden_cases", "SELECT p_partkey::VARCHAR AS case_id, 'naver_sa' AS platform, x.k AS kind, x.v AS value FROM (SELECT p_partkey, unnest([{'k': 'must_keep', 'v': p_name}, {'k': 'must_keep', 'v': p_type}, {'k': 'required_categories', 'v': 'brand'}]) AS x FROM part)")
def s07(spark, d):
    payload = F.expr("""concat('{"case_id":"', p_partkey, '","platform_expectations":{"naver_sa":{"must_keep":["', p_name, '","', p_type, '"],"required_categories":["brand"]}}}')""")
    return files.golden_rows(_part(spark, d).select(payload.alias("payload")))


@query("S08_manifest_texts", "SELECT o_custkey AS image_id, string_agg('w' || o_orderkey, ' ' ORDER BY round_even((o_orderkey % 50) / greatest((o_orderkey % 7)::DOUBLE, 1), 0), (o_orderkey % 50)::DOUBLE, (o_orderkey % 11)::DOUBLE, o_orderkey) AS text FROM orders GROUP BY o_custkey")
def s08(spark, d):
    o = F.col("o_orderkey")
    words = _t(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), o.alias("id"), F.concat(F.lit(" w"), o.cast("string")).alias("text"), (o % 11).cast("double").alias("x"), (o % 50).cast("double").alias("y"), (o % 7).cast("double").alias("height"))
    return labels.manifest_texts(words)


@query("K04_job_summary", "WITH t AS (SELECT o_custkey AS job_id, o_orderstatus = 'F' AS bad FROM orders) SELECT job_id, count(*) AS submitted, count(*) FILTER (NOT bad) AS succeeded, count(*) FILTER (bad) AS failed FROM t GROUP BY job_id")
def k04(spark, d):
    from keyloom.sources import artifacts

    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "FAILED_COLLECTION").otherwise("COMPLETED").alias("status"))
    return artifacts.manifest(o).select("job_id", "submitted", "succeeded", "failed")


@query("H04_ranked_sources", "SELECT page_id, count(*) AS n FROM (SELECT p_partkey AS page_id, unnest(['a', 'b']) FROM part) GROUP BY page_id")
def h04r(spark, d):
    """Two lazy images share a placeholder: the first gives it, the second its own source, and an image in single quotes has been seen."""
    html = F.expr("concat('<img src=\"/blank.gif\" data-src=\"/a', p_partkey, '.jpg\"><img src=\"/blank.gif\" data-src=\"/b', p_partkey, '.jpg\"><img src=\"', '/blank.gif', '\">')")
    return images.image_candidates(_part(spark, d).select(F.col("p_partkey").alias("page_id"), F.lit("https://x.com/p/").alias("url"), html.alias("html"))).groupBy("page_id").agg(F.count("*").alias("n"))
