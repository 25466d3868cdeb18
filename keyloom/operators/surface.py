"""Surface rules of keywords: which wordings a product page can answer. The first rule that holds names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.arrays import any_in, collapse, let, rows_of, texts, unique, where_here
from keyloom.operators.evidence import is_support
from keyloom.operators.interpret import head, measure_only
from keyloom.operators.slots import PRICE_BAND

_EXACT_PRICE = (r"[0-9]{1,3}(?:,[0-9]{3})+(?:원)?", r"[0-9]{4,}(?:원)?", r"[0-9]+\s*(?:만원|천원|달러|usd|유로)(?!대)")
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def price_band(keyword: Column) -> Column:
    return F.lower(keyword).rlike(PRICE_BAND)


def exact_price(keyword: Column) -> Column:
    """A price in figures that is no band."""
    found = F.lit(False)
    for p in _EXACT_PRICE:
        found = found | F.lower(keyword).rlike(_EDGE + p + _END)
    return ~price_band(keyword) & found


def overlaps(keyword: Column, terms: Column) -> Column:
    """Whether a keyword holds a term, is held by one, or shares a word of two letters or more with one."""
    own = lambda low: F.filter(F.split(low, dims.SPACE + "+"), lambda w: F.length(w) >= 2)
    meets = lambda t, low, words: F.contains(low, t) | F.contains(t, low) | F.arrays_overlap(words, F.filter(F.split(t, " "), lambda w: F.length(w) >= 2))
    within = lambda low, words: F.exists(F.transform(terms, lambda t: F.lower(collapse(t))), lambda t: (t != "") & F.coalesce(meets(t, low, words), F.lit(False)))
    return let(F.lower(keyword), lambda low: let(own(low), lambda words: within(low, words)))


def short_model(keyword: Column, name: Column) -> Column:
    """The name and a model number or generation."""
    suffix = F.trim(F.substring(keyword, F.length(name) + 1, F.length(keyword)))
    return keyword.startswith(F.concat(name, F.lit(" "))) & F.lower(suffix).rlike(r"(?U)^\d{1,2}(?:세대|gen)?$")


def bare_suffixes(it: dict[str, Column]) -> Column:
    """What may not follow the name alone."""
    return unique(F.concat(F.array(it["product_category"]), it["secondary"], it["audience"], it["concerns"], it["usage"], texts(dims.BARE_SUFFIXES)))


def suffix_of(keyword: Column, name: Column) -> Column:
    """What follows as many characters as the name has."""
    return F.trim(F.substring(keyword, F.length(name) + 1, F.length(keyword)))


def surface_code(keyword: Column, category: Column, it: dict[str, Column] | None = None, verbose: bool = False) -> Column:
    """Code of the first surface rule that a keyword breaks, or null.

    ``it``: columns of the interpretation by name (default: those of the row): name, category (as ``product_category``
    where the row has a category of its own), secondary, audience, concerns, usage, page_class, events, measures, specs,
    ingredients, technology, form_factors; ``bare`` (``bare_suffixes``) where many keywords of a row share it; ``low`` and
    ``suffix`` (lower case, ``suffix_of``) where they are made already.
    """
    it = it or {n: F.col(n) for n in ("name", "product_category", "secondary", "audience", "concerns", "usage", "page_class", "events", "measures", "specs", "ingredients", "technology", "form_factors")}
    name, kind, low = it["name"], it["product_category"], it["low"] if "low" in it else F.lower(keyword)
    prefixed = keyword.startswith(F.concat(name, F.lit(" ")))
    suffix = it["suffix"] if "suffix" in it else suffix_of(keyword, name)
    bare = F.array_contains(it["bare"] if "bare" in it else bare_suffixes(it), suffix)
    features = F.concat(it["measures"], it["specs"], it["ingredients"], it["technology"], it["form_factors"])
    events = F.transform(it["events"], F.lower)
    purpose = prefixed & suffix.endswith("용") & ~measure_only(suffix) & ~exact_price(suffix) & ~price_band(suffix)
    plain = F.lit(not verbose)
    of = lambda *c: category.isin(*c)
    has = lambda words: any_in(keyword, texts(words))
    has_low = lambda words: any_in(low, texts(words))
    competitor_end = F.endswith(keyword, F.concat(F.lit("대체 "), head(kind))) | has(dims.COMPARISON_SHAPES)
    rules = [
        ("surface_scaffold", plain & of("purchase_intent", "problem_solution", "benefit_price") & has(dims.SURFACE_SCAFFOLDS)),
        ("surface_product_action", has_low(dims.SURFACE_ACTIONS)),
        ("surface_informational", ~is_support(it["page_class"]) & has_low(dims.SURFACE_INFORMATION)),
        ("surface_purchase_suffix", of("purchase_intent") & has_low(dims.PURCHASE_SUFFIXES)),
        ("surface_merchandising", plain & ~of("brand") & has(dims.SURFACE_MERCHANDISE)),
        ("surface_feature_scaffold", of("feature_attribute") & has(dims.FEATURE_SCAFFOLDS)),
        ("surface_product_prefix", of("feature_attribute") & prefixed & ~F.array_contains(it["measures"], suffix)),
        ("surface_ungrounded_feature", of("feature_attribute") & ~overlaps(keyword, features)),
        ("surface_price_shape", of("benefit_price") & ~F.contains(keyword, F.lit("가격")) & ~price_band(keyword)),
        ("surface_raw_price", of("benefit_price") & exact_price(keyword)),
        ("surface_product_prefix", of("season_event") & prefixed),
        ("surface_season_scaffold", of("season_event") & has(dims.SEASON_SCAFFOLDS)),
        ("surface_unsupported_event", of("season_event") & has_low(dims.EVENT_TERMS) & ~any_in(low, events)),
        ("surface_ungrounded_season", of("season_event") & ~any_in(low, events) & ~overlaps(keyword, it["usage"])),
        ("surface_product_prefix", keyword == F.concat(name, F.lit(" "), kind)),
        ("surface_product_purpose_suffix", prefixed & bare),
        ("", of("purchase_intent") & short_model(keyword, name)),
        ("surface_product_prefix", of("purchase_intent", "long_tail", "problem_solution") & prefixed),
        ("surface_ungrounded_problem", of("problem_solution") & ~overlaps(keyword, F.concat(it["concerns"], it["usage"]))),
        ("surface_product_purpose_suffix", purpose),
        ("surface_competitor_shape", of("competitor_comparison") & competitor_end),
        ("surface_product_purpose_suffix", of("season_event") & (keyword.endswith(dims.PURPOSE_ENDS[0]) | keyword.endswith(dims.PURPOSE_ENDS[1]))),
    ]
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for code, rule in rules[1:]:
        out = out.when(F.coalesce(rule, F.lit(False)), code)
    return F.nullif(out, F.lit(""))


def with_surface(rows: DataFrame, verbose: bool = False) -> DataFrame:
    """Rows with ``surface`` (the code or null) and ``surface_hard``."""
    out = rows.withColumn("surface", surface_code(collapse(F.col("keyword")), F.col("category"), verbose=verbose))
    return out.withColumn("surface_hard", F.coalesce(F.col("surface").isin(*dims.HARD_SURFACES), F.lit(False)))


def cleaned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without empty keywords and hard surfaces, and the dropped ones with stage and code."""
    out = with_surface(rows.where(collapse(F.col("keyword")) != ""))
    dropped = where_here(out, F.col("surface_hard")).select("url", "keyword", "category", F.coalesce("slot_type", F.lit("")).alias("slot_type"), F.lit("surface_cleanup").alias("drop_stage"), F.col("surface").alias("drop_reason_code"))
    return where_here(out, ~F.col("surface_hard")), dropped


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(collapse(text)), F.lit("([A-Za-z0-9]+|[가-힣]+)"), F.lit(1))


def extends_head(keyword: Column, head_: Column) -> Column:
    """Whether a keyword says more than a head: it ends with it, or holds all its words among more."""
    k, h = F.lower(collapse(keyword)), F.lower(collapse(head_))
    more = (F.size(_tokens(keyword)) > F.size(_tokens(head_))) & (F.size(_tokens(head_)) > 0) & (F.size(F.array_except(_tokens(head_), _tokens(keyword))) == 0)
    return (k != "") & (h != "") & (k != h) & (k.endswith(F.concat(F.lit(" "), h)) | more)


def preservable(head_: Column, name: Column, brand: Column, short: Column) -> Column:
    """Whether a head may be put back: a short wording without measure, price, purchase word or brand, and not the product's own name."""
    text, low = collapse(head_), F.lower(collapse(head_))
    branded = (F.coalesce(brand, F.lit("")) != "") & F.contains(low, F.lower(F.coalesce(brand, F.lit(""))))
    return (text != "") & ~measure_only(text) & ~exact_price(text) & ~price_band(text) & ~any_in(low, texts(dims.PURCHASE_SUFFIXES)) & ~branded & ~((short != "") & (low == F.lower(short))) & (F.size(_tokens(text)) <= 3)


def missing_heads(rows: DataFrame, most: int = 2) -> DataFrame:
    """Generic heads to put back: (url, keyword), at most ``most`` for each product, in the order of its category terms.

    ``rows``: one row per product with url, name, brand, short, category_terms, ``generic`` (keywords of its generic rows) and
    ``sources`` (keywords of the generic intents it came from). A head that is put back counts as a row for later ones.
    """
    start = F.struct(F.col("generic").alias("rows"), F.array().cast("array<string>").alias("put"))

    def step(state: Column, term: Column) -> Column:
        text = collapse(term)
        there = F.exists(state["rows"], lambda r: F.lower(collapse(r)) == F.lower(text))
        sourced = F.exists(F.col("sources"), lambda r: F.lower(collapse(r)) == F.lower(text))
        grows = F.exists(state["rows"], lambda r: extends_head(r, text))
        fits = (F.size(state["put"]) < most) & ~there & sourced & grows & preservable(text, F.col("name"), F.col("brand"), F.col("short"))
        return F.when(fits, F.struct(F.concat(state["rows"], F.array(text)).alias("rows"), F.concat(state["put"], F.array(text)).alias("put"))).otherwise(state)

    return rows_of(rows, F.aggregate("category_terms", start, step, lambda s: s["put"]), "url", item="keyword", place="ord")
