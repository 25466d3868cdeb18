"""DuckDB SQL pieces that state the same rules as the column expressions, for holding results against each other."""

from __future__ import annotations

from keyloom import dims
from keyloom.functions import keywords as K

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def host(u: str) -> str:
    return f"regexp_replace(regexp_replace(lower(regexp_extract({u}, {q(_PARTS)}, 2)), '^.*@', ''), ':[0-9]*$', '')"


def canonical(u: str) -> str:
    scheme = f"lower(regexp_extract({u}, {q(_PARTS)}, 1))"
    port = f"regexp_extract(regexp_extract({u}, {q(_PARTS)}, 2), ':0*([0-9]+)$', 1)"
    path = f"regexp_replace(regexp_extract({u}, {q(_PARTS)}, 3), '/+', '/', 'g')"
    path = f"(CASE WHEN {path} = '' THEN '/' WHEN {path} <> '/' AND {path} LIKE '%/' THEN regexp_replace({path}, '/$', '') ELSE {path} END)"
    plain = lambda x: f"url_decode(replace({x}, '+', ' '))"
    form = lambda x: f"replace(replace(url_encode({x}), '%20', '+'), '%7E', '~')"
    parts = f"list_filter(string_split(regexp_extract({u}, {q(_PARTS)}, 4), '&'), lambda p: regexp_matches(p, '^[^=]*=.'))"
    pairs = f"list_transform({parts}, lambda p: struct_pack(k := {plain("split_part(p, '=', 1)")}, v := {plain("substr(p, instr(p, '=') + 1)")}))"
    kept = f"list_filter({pairs}, lambda p: p.k NOT IN {dims.TRACKING_KEYS!r} AND NOT starts_with(p.k, 'utm_'))"
    query = f"array_to_string(list_transform(list_sort({kept}), lambda p: {form('p.k')} || '=' || {form('p.v')}), '&')"
    return f"({scheme} || '://' || {host(u)} || CASE WHEN {port} IN ('', '0') OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END)"


HOST_BRAND = f"""
WITH h AS (SELECT page_id, list_filter(string_split({host('url')}, '.'), lambda x: x <> '' AND x <> 'www') AS l FROM pages),
c AS (SELECT page_id, l, CASE WHEN len(l) >= 2 AND l[-2] = 'co' AND len(l) >= 3 THEN l[-3] WHEN len(l) >= 2 THEN l[-2] ELSE l[1] END AS x FROM h)
SELECT page_id, CASE WHEN list_has_any(l, {lst(dims.KNOWN_HOSTS)}) THEN list_transform(list_filter(l, lambda v: v IN {tuple(dims.KNOWN_HOSTS)!r}), lambda v: MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in dims.KNOWN_HOSTS.items())}}}[v])[1]
  WHEN len(l) = 0 OR len(list_filter(l, lambda v: v IN {dims.EVIDENCE_MARKETPLACES!r})) > 0 THEN NULL WHEN length(x) > 2 THEN upper(substr(x, 1, 1)) || substr(x, 2) ELSE upper(x) END AS brand FROM c
"""


def unescape(t: str) -> str:
    """The references that the tables hold; ``&amp`` last, with or without its semicolon."""
    for entity, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, {q(entity)}, {q(sign)})"
    return f"regexp_replace({t}, '&amp;?', '&', 'g')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '[\\s\\x{{85}}\\x{{a0}}]+', ' ', 'g'))"


def group(h: str, pattern: str) -> str:
    return f"nullif({collapse(unescape(f'regexp_extract({h}, {q(chr(40) + "?is" + chr(41) + pattern)}, 1)'))}, '')"


def title(h: str) -> str:
    return group(h, "<title[^>]*>(.*?)</title>")


def meta(h: str, name: str, attribute: str = "name") -> str:
    return group(h, f"<meta[^>]+{attribute}=[\"']{name}[\"'][^>]+content=[\"'](.*?)[\"']")


def tidied(t: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(replace({t}, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def visible(h: str) -> str:
    out = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, '(?is)<{tag}.*?>.*?</{tag}>', ' ', 'g')"
    return tidied(unescape(f"regexp_replace({out}, '<[^>]+>', chr(10), 'g')"))


def blocks(t: str) -> str:
    return f"list_filter(list_transform(string_split_regex({t}, '\\n+'), lambda x: {collapse('x')}), lambda x: regexp_matches(x, '[A-Za-z0-9\\x{{3131}}-\\x{{D79D}}]'))[1:20]"


def hits(t: str, patterns) -> str:
    return f"list_filter({lst(patterns)}, lambda p: contains({t}, p))"


_HERO = q(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(dims.HERO_NOUNS) + r")(?:[^\p{L}\p{N}_]|$)")
_NEW = "list_filter(raw_tokens, lambda x, i: list_position(list_transform(raw_tokens, lambda y: lower(y)), lower(x)) = i)[1:12]"
_PLAIN = "SELECT page_id, url, html, NULL::VARCHAR AS ld_name, NULL::VARCHAR AS ld_text, NULL::VARCHAR AS ld_brand, false AS ld_product, 0 AS payloads FROM pages"


def _generic(t: str) -> str:
    toks = f"regexp_extract_all({t}, '[A-Za-z0-9\\x{{3131}}-\\x{{D79D}}][A-Za-z0-9\\x{{3131}}-\\x{{D79D}}.+&-]*')"
    return f"CASE WHEN len({toks}) = 0 THEN true WHEN regexp_matches(lower({t}), 'waiting room|captcha|forbidden|access denied') THEN false WHEN regexp_matches({t}, '[0-9]') THEN false ELSE len({toks}) <= 2 END"


def snapshot(source: str = _PLAIN, text: str | None = None, brand: bool = True, schema: str = "ld_product", lang: str = "lang") -> str:
    """The snapshot rules over a relation of page_id, url, html and what its JSON-LD is known to say."""
    points = [
        "CASE WHEN len(regexp_extract_all(coalesce(title, ''), '[A-Za-z0-9가-힣]+')) >= 2 THEN 0.12::DOUBLE ELSE 0::DOUBLE END",
        "CASE WHEN coalesce(product_name, '') <> '' AND (title IS NULL OR product_name <> title) THEN 0.08::DOUBLE ELSE 0::DOUBLE END",
        f"CASE WHEN len({hits('lower(url)', dims.PRODUCT_URL)}) > 0 THEN 0.18::DOUBLE ELSE 0::DOUBLE END",
        "CASE WHEN has_schema THEN 0.25::DOUBLE ELSE 0::DOUBLE END",
        "CASE WHEN len(raw_tokens) > 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END",
        f"CASE WHEN regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(product_name, '')), {_HERO}) THEN 0.12::DOUBLE ELSE 0::DOUBLE END",
        "CASE WHEN len(price) > 0 AND len(buy) > 0 THEN 0.15::DOUBLE WHEN len(price) > 0 OR len(buy) > 0 THEN 0.08::DOUBLE ELSE 0::DOUBLE END",
        "CASE WHEN chars > 800 THEN 0.05::DOUBLE ELSE 0::DOUBLE END",
    ]
    parts = ", ".join(f"nullif({c}, '')" for c in ("title", "meta", "product_name", *(["ld_brand"] if brand else [])))
    return f"""
WITH src AS ({source}),
b0 AS (SELECT *, {title('html')} AS raw_title, {meta('html', 'og:title', 'property')} AS og, coalesce({meta('html', 'description')}, {meta('html', 'og:description', 'property')}, ld_text) AS meta,
  {group('html', '<html[^>]+lang=["' + chr(39) + ']([^"' + chr(39) + ']+)["' + chr(39) + ']')} AS lang, {visible('html')} AS raw_text FROM src),
b1 AS (SELECT *, CASE WHEN coalesce(raw_title, '') <> '' AND NOT ({_generic('raw_title')}) THEN raw_title ELSE coalesce(og, ld_name, raw_title) END AS title, {text or 'raw_text'} AS text FROM b0),
base AS (SELECT *, coalesce(ld_name, og, title, url) AS product_name, {schema} AS has_schema, coalesce({lang}, 'en') AS spoken FROM b1),
low AS (SELECT *, lower(concat_ws(' ', title, meta, text)) AS lowered, length(text) AS chars, regexp_extract_all(concat_ws(' ', {parts}), '([A-Za-z0-9][A-Za-z0-9.+-]{{2,}})', 1) AS raw_tokens FROM base),
sig AS (SELECT *, {hits('lowered', dims.BUY)} AS buy, {hits('lowered', dims.STOCK)} AS stock, {hits('lowered', dims.PROMO)} AS promo,
  {hits('lowered', dims.SUPPORT)} AS support, {hits('lowered', dims.DOWNLOAD)} AS download, {hits('lowered', dims.WAITING)} AS waiting,
  list_concat({hits('lowered', dims.BLOCKER)}, {hits('lower(html)', dims.BLOCKER_HTML)}) AS blocker,
  list_filter([{', '.join(f"CASE WHEN regexp_matches(lowered, {q(p)}) THEN 'price_{i}' END" for i, p in enumerate(dims.PRICE, 1))}], lambda x: x IS NOT NULL) AS price,
  length(text) - length(regexp_replace(text, '[가-힣]', '', 'g')) AS hangul, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS latin FROM low),
snap AS (SELECT *, {_NEW} AS tokens, least(0.15::DOUBLE + {' + '.join(points)}, 0.95::DOUBLE) AS confidence,
  least(CASE WHEN len(price) > 0 THEN 0.45::DOUBLE ELSE 0::DOUBLE END + CASE WHEN len(buy) > 0 THEN 0.35::DOUBLE ELSE 0::DOUBLE END + CASE WHEN len(stock) > 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 0.95::DOUBLE) AS sellability,
  CASE WHEN chars >= 400 THEN 'sufficient' ELSE 'borderline' END AS sufficiency, CASE WHEN len(price) > 0 OR len(buy) > 0 THEN 'sellable' ELSE 'non_sellable' END AS sellability_state,
  CASE WHEN list_has_any(stock, ['out of stock', '품절']) THEN 'OutOfStock' WHEN len(stock) > 0 THEN 'InStock' ELSE 'Unknown' END AS stock_state FROM sig)
"""


_ANY = lambda t, ps: f"len({hits(t, ps)}) > 0"


def classed(source: str = _PLAIN, **more) -> str:
    return f"""{snapshot(source, **more)},
pre AS (SELECT *, ({_ANY("lower(coalesce(title, ''))", dims.SUPPORT_TITLE)}) OR contains(lower(url), 'support.apple.com') AS helps, {_ANY('lower(url)', dims.LANDING_URL)} AS landing FROM snap),
str AS (SELECT *, confidence >= 0.65::DOUBLE OR (has_schema AND (len(price) > 0 OR len(buy) > 0)) OR (len(price) > 0 AND len(buy) > 0 AND confidence >= 0.55::DOUBLE AND NOT landing) AS strong FROM pre),
cls AS (SELECT *, CASE WHEN len(blocker) > 0 THEN 'blocked_page' WHEN len(waiting) > 0 THEN 'waiting_page'
  WHEN helps AND len(support) > 0 AND len(download) >= 3 THEN 'document_download_heavy_support_page' WHEN helps AND len(support) > 0 THEN 'support_spec_page'
  WHEN strong AND len(price) > 0 AND len(buy) > 0 AND chars < 2500 THEN 'image_heavy_commerce_pdp' WHEN strong AND (len(price) > 0 OR len(buy) > 0) THEN 'commerce_pdp'
  WHEN len(promo) > 0 AND NOT strong AND (landing OR len(promo) >= 2) THEN 'promo_heavy_commerce_landing'
  WHEN contains(lowered, '__nuxt__={{}};') OR chars < 250 OR (length(lowered) - length(replace(lowered, '/products/', ''))) > 80 THEN 'non_product_page'
  WHEN contains(lower(url), '/shop/') OR contains(lower(url), '/product/') THEN 'marketing_only_pdp' WHEN coalesce(title, '') <> '' THEN 'product_marketing_page' ELSE 'non_product_page' END AS page_class FROM str),
classed AS (SELECT *, page_class IN {dims.SUPPORTED_CLASSES!r} AS supported FROM cls)
"""


def _value(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else q(v)


ROWS = f"""
WITH t(ord, category, pattern, reason, evidence_tier, quality_score) AS (VALUES {', '.join('(' + ', '.join(map(_value, x)) + ')' for x in dims.TEMPLATES)}),
r AS (SELECT 'https://shop.example.com/product/' || p_partkey AS url, p_name AS product_name, p_brand AS brand, p_type AS type, CASE WHEN p_size % 5 = 0 THEN 'skincare' ELSE 'general' END AS kind, ord, category, reason, evidence_tier, quality_score,
  replace(replace(replace(pattern, '{{b}}', p_brand), '{{n}}', p_name), '{{t}}', p_type) AS keyword,
  CASE WHEN category = 'negative' THEN '제외키워드' WHEN category IN ('brand', 'purchase_intent') THEN '완전일치' ELSE '확장소재' END AS naver_match,
  CASE WHEN category = 'negative' THEN 'negative' WHEN category = 'brand' THEN 'exact' WHEN category IN ('long_tail', 'purchase_intent', 'problem_solution') THEN 'phrase' ELSE 'broad' END AS google_match
  FROM part CROSS JOIN t)
"""


def tok(e: str, pattern: str) -> str:
    return f"regexp_extract_all(lower({e}), {q(pattern)})"


def nondigit(t: str) -> str:
    return f"list_filter({t}, lambda x: NOT regexp_matches(x, '^[0-9]+$'))"


def halves(t: str) -> str:
    return f"(len({t}) >= 4 AND len({t}) % 2 = 0 AND {t}[1:(len({t}) // 2)] = {t}[(len({t}) // 2 + 1):len({t})])"


def neighbours(t: str) -> str:
    return f"len(list_filter(range(1, len({t})), lambda i: {t}[i] = {t}[i + 1] AND NOT regexp_matches({t}[i], '^[0-9]+$'))) > 0"


def repeated(t: str, w: str) -> str:
    many = f"(len({w}) >= 3 AND (len(list_filter({w}, lambda x: len(list_filter({w}, lambda y: y = x)) >= 3)) > 0 OR {w}[1] = {w}[len({w})]))"
    return f"({halves(t)} OR {neighbours(t)} OR {many})"


def has_any(e: str, values) -> str:
    return f"len({hits(e, values)}) > 0"


def unit(e: str) -> str:
    return f"list_has_any({tok(e, K.POLICY_TOKEN)}, {lst(dims.UNITS)})"


def low_information(k: str) -> str:
    parts = f"list_filter(string_split_regex(lower({k}), '\\s+'), lambda x: x <> '')"
    return f"({has_any(f'lower({k})', dims.LOW_INFORMATION)} OR {has_any(f'lower({k})', dims.DOC_BOILERPLATE)} OR {unit(k)} OR coalesce(len({parts}) >= 2 AND {parts}[1] = {parts}[2], false))"


def banned() -> str:
    return f"list_filter({lst(dims.BANNED_TERMS)}, lambda t: contains(keyword || CASE WHEN reason = '' THEN '' ELSE ' ' || reason END, t))[1]"


def strip(t: str, values) -> str:
    """Tokens up to the last that is not in ``values``."""
    keep = f"coalesce(list_max(list_transform({t}, lambda x, i: CASE WHEN x IN {tuple(values)!r} THEN 0 ELSE i END)), 0)"
    return f"{t}[1:{keep}]"


def signature(k: str) -> str:
    t = tok(k, K.EVAL_TOKEN)
    s = strip(strip(t, dims.DUPLICATE_SUFFIXES), dims.LIGHT_FILLERS)
    return f"array_to_string(CASE WHEN len({s}) = 0 THEN {t} ELSE {s} END, ' ')"


def family(k: str) -> str:
    return f"array_to_string(list_filter({tok(k, K.FAMILY_TOKEN)}, lambda x: x NOT IN {dims.SELECTION_MODIFIERS!r})[1:2], ' ')"


def filler(k: str) -> str:
    return f"({has_any(k, dims.FILLER_SUFFIXES)} OR regexp_matches(trim({k}), '(?:^|\\s)[0-9]+$') OR len(list_filter({tok(k, K.EVAL_TOKEN)}, lambda x: x IN {dims.LIGHT_FILLERS!r})) >= 2)"


def natural(k: str) -> str:
    t = tok(k, K.EVAL_TOKEN)
    return f"greatest(0, 100 - CASE WHEN {filler(k)} THEN 60 ELSE 0 END - CASE WHEN len(list_distinct({t})) <> len({t}) THEN 20 ELSE 0 END - CASE WHEN length(replace({k}, ' ', '')) <= 2 THEN 30 ELSE 0 END - CASE WHEN len({t}) >= 9 THEN 10 ELSE 0 END - CASE WHEN len({t}) >= 11 THEN 10 ELSE 0 END - CASE WHEN list_has_any({t}, {lst(dims.EVAL_BOILERPLATE)}) THEN 40 ELSE 0 END - CASE WHEN length({k}) > 28 THEN 10 ELSE 0 END - CASE WHEN len(list_filter({t}, lambda x: x IN {dims.MODIFIERS!r})) >= 4 THEN 15 ELSE 0 END)"


def _count(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, {part}, ''))) / greatest(length({part}), 1))"


_EXACT = f"""CASE WHEN lower(kw) IN (lower(product_name), lower(short), lower(brand), lower(brand || ' ' || short)) THEN false WHEN len(t) = 0 THEN true WHEN len(list_distinct(t)) <> len(t) THEN true
 WHEN {_count('lower(kw)', 'lower(product_name)')} > 1 THEN true WHEN short <> product_name AND {_count('lower(kw)', 'lower(short)')} > 1 THEN true WHEN regexp_matches(lower(kw), {q(K.MEASURE)}) THEN true
 WHEN len(t) = 1 THEN lower(kw) <> lower(brand) ELSE category = 'brand' AND NOT contains(lower(kw), lower(brand)) AND len(t) <= 2 END"""
#: Terms of the negative taxonomy for the fixture's type: every fifth product is skincare, the others are of no known type.
ALLOWED = f"(SELECT unnest(CASE WHEN kind = 'skincare' THEN {lst([t for t, k in dims.NEGATIVE_TERMS.items() if 'skincare' in k])} ELSE {lst([t for t, k in dims.NEGATIVE_TERMS.items() if 'general' in k])} END))"
#: The fixture's competitors are three brands, its category terms two types, and a product is known by its name.
_RIVALS = ("Brand#3", "Brand#7", "Brand#11")
_RIVAL_OF = "list_filter(['Brand#3', 'Brand#7', 'Brand#11'], lambda c: lower(c) <> lower(brand) AND contains(lower(kw), lower(c)))[1]"
RIVAL = f"coalesce({_RIVAL_OF} IS NOT NULL AND NOT regexp_matches(lower(kw), {q(K.MEASURE)}) AND NOT {has_any('kw', dims.COMPARISON_SHAPES)} AND len(t) >= 2 AND (contains(lower(kw), 'economy') OR contains(lower(kw), 'small') OR (contains(lower(kw), lower(product_name)) AND ({has_any('kw', ('vs', '비교', '대체', '대안'))}))), false)"
ISSUES = f"""{ROWS},
k1 AS (SELECT *, trim(regexp_replace(keyword, '\\s+', ' ', 'g')) AS kw, product_name AS short FROM r),
k2 AS (SELECT *, {tok('kw', K.POLICY_TOKEN)} AS t FROM k1), k3 AS (SELECT *, {nondigit('t')} AS w FROM k2),
i0 AS (SELECT *, list_filter([CASE WHEN {repeated('t', 'w')} THEN 'repeated_phrase' END, CASE WHEN {unit('kw')} THEN 'placeholder_unit' END, CASE WHEN {has_any('lower(kw)', dims.DOC_BOILERPLATE)} THEN 'doc_boilerplate' END,
  CASE WHEN (naver_match IN ('완전일치', 'exact') OR google_match IN ('완전일치', 'exact')) AND ({_EXACT}) THEN 'invalid_exact' END,
  CASE WHEN category = 'negative' AND NOT (kw IN {ALLOWED} OR (starts_with(kw, product_name || ' ') AND trim(substr(kw, length(product_name) + 1)) IN {ALLOWED})) THEN 'invalid_negative' END,
  CASE WHEN category = 'competitor_comparison' AND NOT ({RIVAL}) THEN 'invalid_competitor' END,
  CASE WHEN category <> 'negative' AND list_has_any(t, {lst(dims.PLACEHOLDER_PRODUCTS)}) THEN 'placeholder_product_term' END, CASE WHEN category <> 'negative' AND kind = 'skincare' AND {has_any('kw', dims.SKINCARE_BLOCKED)} THEN 'domain_mismatch_phrase' END, CASE WHEN category <> 'negative' AND {low_information('kw')} THEN 'low_information' END], lambda x: x IS NOT NULL) AS issues FROM k3),
iss AS (SELECT *, list_filter(issues, lambda x: x IN {dims.HARD_ISSUES!r}) AS hard FROM i0)
"""
SCORED = f"""{ISSUES},
fam AS (SELECT *, {family('keyword')} AS family FROM iss WHERE category <> 'negative'),
fs AS (SELECT *, CASE WHEN family = '' THEN 0 ELSE count(*) OVER (PARTITION BY url, category, family) END AS fsize FROM fam),
scored AS (SELECT *, greatest(0, least(10000, CASE quality_score WHEN 'high' THEN 10000 WHEN 'medium' THEN 7200 WHEN 'low' THEN 4500 ELSE 7200 END
  + CASE WHEN evidence_tier = 'direct' THEN 1200 WHEN evidence_tier = 'weak' THEN -1000 WHEN evidence_tier IS NOT NULL THEN 400 ELSE 0 END
  - CASE WHEN list_contains(issues, 'low_information') THEN 1200 ELSE 0 END - CASE WHEN fsize > 1 THEN least(1600, (fsize - 1) * 800) ELSE 0 END))::INTEGER AS score FROM fs)
"""
_SIDES = "sides AS (SELECT *, 'naver_sa' AS platform, naver_match AS label FROM iss WHERE naver_match <> '' UNION ALL SELECT *, 'google_sa', google_match FROM iss WHERE google_match <> '')"
VALIDATION = f"""{ISSUES}, {_SIDES},
b AS (SELECT *, {banned()} AS ban, category <> 'negative' OR label IN ('제외키워드', 'negative') AS judged FROM sides),
a AS (SELECT url, platform, count(*) FILTER (category <> 'negative') AS positives, count(*) FILTER (category = 'negative') AS negatives, count(*) FILTER (category <> 'negative' AND evidence_tier = 'weak') AS weak,
  count(*) FILTER (judged AND len(hard) > 0) AS violations, arg_min(ban, ord) FILTER (judged AND ban IS NOT NULL) AS ban, arg_min(category || ':' || keyword || ':' || array_to_string(hard, ', '), ord) FILTER (judged AND len(hard) > 0) AS bad FROM b GROUP BY url, platform),
f AS (SELECT *, CASE WHEN ban IS NOT NULL THEN 'banned term emitted: ' || ban WHEN bad IS NOT NULL THEN bad WHEN positives < 100 THEN platform || ' positive rows below 100' WHEN negatives = 0 THEN platform || ' missing negative rows' WHEN weak * 5 > positives THEN platform || ' weak-tier ratio exceeded 20%' END AS failure_detail FROM a)
SELECT url, platform, positives, negatives, weak, violations, failure_detail, CASE WHEN failure_detail IS NULL THEN NULL WHEN ban IS NULL AND bad IS NULL AND positives < 100 THEN 'generation_count_shortfall' ELSE 'generation_rule_violation' END AS failure_code, CASE WHEN failure_detail IS NULL THEN 'COMPLETED' ELSE 'FAILED_GENERATION' END AS status FROM f
"""
METRICS = f"""{ISSUES}, {_SIDES},
a AS (SELECT url, platform, count(*) FILTER (category <> 'negative') AS total, count(*) FILTER (category <> 'negative' AND {filler('keyword')}) AS fillers, sum(CASE WHEN category <> 'negative' THEN {natural('keyword')} ELSE 0 END)::BIGINT AS natural_sum,
  count(DISTINCT CASE WHEN category <> 'negative' THEN trim(keyword) END) AS exact_distinct, count(DISTINCT CASE WHEN category <> 'negative' THEN {signature('keyword')} END) AS semantic_distinct,
  count(*) FILTER (category <> 'negative' AND length(trim(reason)) > 5) AS reasoned, count(*) FILTER (category <> 'negative' AND len(hard) > 0) AS malformed, count(*) FILTER (category = 'negative' AND len(hard) > 0) AS invalid_negatives FROM sides GROUP BY url, platform)
SELECT *, array_to_string(list_filter([CASE WHEN total < 100 THEN 'insufficient_positive_rows' END, CASE WHEN fillers * 100 >= total * 15 THEN 'high_filler_ratio' END, CASE WHEN natural_sum < total * 70 THEN 'low_naturalness' END, CASE WHEN semantic_distinct * 100 < total * 95 THEN 'low_semantic_uniqueness' END, CASE WHEN malformed > 0 THEN 'malformed_positive_keywords' END, CASE WHEN invalid_negatives > 0 THEN 'invalid_negative_keywords' END], lambda x: x IS NOT NULL), ',') AS failures FROM a WHERE total > 0
"""
LARGEST = f"""
WITH totals AS (SELECT DISTINCT p_size AS total FROM part UNION SELECT unnest([0, 9, 100, 160, 161, 999]) AS total), dim(pos, category, target) AS (VALUES {', '.join(f'({i}, {q(c)}, {t})' for i, (c, t) in enumerate(dims.CATEGORY_TARGETS.items()))}),
x AS (SELECT total, pos, category, target, greatest(0, total - 9) AS rest, target * greatest(0, total - 9) AS scaled FROM totals CROSS JOIN dim),
y AS (SELECT *, scaled // 100 AS fl, scaled % 100 AS fraction FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY total ORDER BY fraction DESC, target DESC, pos) AS place, rest - sum(fl) OVER (PARTITION BY total) AS remain FROM y)
SELECT total::INTEGER AS total, category, (CASE WHEN total <= 0 THEN 0 WHEN total = 100 THEN target ELSE 1 + fl + CASE WHEN place <= remain THEN 1 ELSE 0 END END)::BIGINT AS seats FROM z
"""
DIVISOR = """
WITH d AS (SELECT p_brand AS key, p_type AS category, least(count(*), 9) AS available, max(p_size) AS target, 1 + (min(p_size) % 4) / 4.0::DOUBLE AS strength, 20 AS total FROM part GROUP BY p_brand, p_type),
a AS (SELECT *, target * strength AS weight, row_number() OVER (PARTITION BY key ORDER BY category) AS pos, row_number() OVER (PARTITION BY key ORDER BY strength DESC, target DESC, category) AS lead, count(*) OVER (PARTITION BY key) AS n FROM d),
e AS (SELECT a.*, k FROM a, range(1, 9) g(k) WHERE total > n AND k < available),
w AS (SELECT key, category, count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight / (k + 0.5::DOUBLE) DESC, available - k DESC, target DESC, pos, k) AS place FROM e) WHERE place <= total - n GROUP BY key, category)
SELECT a.key, a.category, (CASE WHEN a.total >= a.n OR a.lead <= a.total THEN 1 ELSE 0 END + coalesce(w.more, 0))::BIGINT AS seats FROM a LEFT JOIN w ON w.key = a.key AND w.category = a.category
"""
SLOTS = """
WITH s AS (SELECT p_brand AS key, p_type AS slot, greatest(1, count(DISTINCT p_name)) AS w, 17 AS total, p_type = 'ECONOMY' AS prim FROM part GROUP BY p_brand, p_type),
x AS (SELECT *, (greatest(0, total - 1) * w) // sum(w) OVER (PARTITION BY key) AS fl FROM s),
y AS (SELECT *, greatest(0, total - 1) - sum(fl) OVER (PARTITION BY key) AS remain, row_number() OVER (PARTITION BY key ORDER BY w DESC, prim DESC, slot) AS place FROM x)
SELECT key, slot, (CASE WHEN prim THEN 1 ELSE 0 END + fl + CASE WHEN place <= remain THEN 1 ELSE 0 END)::BIGINT AS seats FROM y
"""
