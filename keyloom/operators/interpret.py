"""Interpretation of evidence packs: one row per product, its facets as arrays.

A pack has url, page_class, product_name, sellability_state and ``facts`` (see ``evidence``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import keywords as K
from keyloom.functions.arrays import any_in, collapse, let, none, texts, unique, words_of
from keyloom.operators import product
from keyloom.operators.evidence import is_support, trimmed

_MEASURE_ONLY = r"(?iU)^\d+(?:\.\d+)?\s?(?:" + "|".join((*dims.UNITS, "형")) + ")$"
_MEASURES = r"(?iU)\d+(?:\.\d+)?\s?(?:" + "|".join((*dims.EVIDENCE_UNITS, "형")) + ")"


# -- picks from facts


def first_value(facts: Column, kind: str) -> Column:
    """Value of the first fact of a type; null if there is none."""
    return F.trim(F.get(F.filter(facts, lambda f: f["type"] == kind), F.lit(0))["value"])


def values_by_types(facts: Column, types: tuple[str, ...]) -> Column:
    return F.transform(F.filter(facts, lambda f: f["type"].isin(*types)), lambda f: f["value"])


def values_by_tags(facts: Column, tags: tuple[str, ...]) -> Column:
    return F.transform(F.filter(facts, lambda f: F.arrays_overlap(f["tags"], texts(tags))), lambda f: f["value"])


def facet(facts: Column, types: tuple[str, ...], tags: tuple[str, ...]) -> Column:
    """Values of facts of the types, then of those with one of the tags, each once."""
    return unique(F.concat(values_by_types(facts, types), values_by_tags(facts, tags)))


def audience(facts: Column) -> Column:
    own = F.filter(facts, lambda f: f["type"].isin("skin_type", "audience") | F.array_contains(f["tags"], "audience"))
    return unique(F.transform(own, lambda f: f["value"]))


def usage(facts: Column) -> Column:
    own = F.filter(facts, lambda f: (f["type"].isin("usage", "use_case") | F.array_contains(f["tags"], "use_case")) & ~F.array_contains(f["tags"], "audience"))
    return unique(F.transform(own, lambda f: f["value"]))


def direct_texts(facts: Column) -> Column:
    return unique(F.transform(F.filter(facts, lambda f: F.lower(F.trim(F.coalesce(f["tier"], F.lit("")))) == "direct"), lambda f: f["value"]))


def mentions(values: Column, needle: Column) -> Column:
    return let(F.lower(needle), lambda n: F.exists(values, lambda v: F.contains(F.lower(v), n)))


def measure_only(text: Column) -> Column:
    return F.trim(text).rlike(_MEASURE_ONLY)


def measures(values: Column) -> Column:
    return unique(F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(_MEASURES), F.lit(0)))))


def attribute_facets(facts: Column) -> dict[str, Column]:
    """Values by bucket: specs before forms before technologies before ingredients."""
    some = F.filter(facts, lambda f: F.trim(F.coalesce(f["value"], F.lit(""))) != "")
    bucket = lambda f: (
        F.when(f["type"].isin("volume", "variant") | measure_only(f["value"]), "specs")
        .when((f["type"] == "texture") | any_in(f["value"], texts(dims.FORM_WORDS)), "form_factors")
        .when(F.array_contains(f["tags"], "brand_technology"), "technology")
        .when(f["type"] == "key_ingredient", "ingredients")
    )
    own = lambda name: unique(F.transform(F.filter(some, lambda f: F.coalesce(bucket(f) == name, F.lit(False))), lambda f: f["value"]))
    return {name: own(name) for name in ("specs", "form_factors", "technology", "ingredients")}


# -- names and categories


def clean_title(text: Column, page_class: Column) -> Column:
    """A product title without what names the store; ``product`` if nothing is left."""

    def parts_kept(value: Column) -> Column:
        parts = F.transform(F.split(value, " - "), F.trim)

        def kept(p: Column) -> Column:
            at = F.array_position(F.transform(p, lambda x: any_in(F.lower(x), texts(dims.STORE_TOKENS))), True).cast("int")
            left = F.when(at == 0, p).otherwise(F.slice(p, 1, F.greatest(at - 1, F.lit(0))))
            return F.when(F.size(left) > 0, trimmed(F.array_join(left, " - "))).otherwise(value)

        return F.when(is_support(page_class) & F.contains(value, F.lit(" - ")), let(parts, kept)).otherwise(value)

    def ended(value: Column) -> Column:
        low = lambda w: F.lower(w)
        words = words_of(value)
        return let(words, lambda w: trimmed(F.array_join(F.slice(w, 1, F.coalesce(F.array_max(F.transform(w, lambda x, i: F.when(~low(x).isin(*dims.STORE_TOKENS), i + 1))), F.lit(0))), " ")))

    first = let(trimmed(F.coalesce(text, F.lit(""))), lambda t: F.when(F.contains(t, F.lit("|")), trimmed(F.substring_index(t, "|", 1))).otherwise(t))
    return F.coalesce(F.nullif(let(let(first, parts_kept), ended), F.lit("")), F.lit("product"))


def short_name(name: Column, brand: Column) -> Column:
    """The name without a first word that is the brand."""
    return let(words_of(name), lambda w: F.when((F.size(w) > 1) & (F.lower(F.get(w, F.lit(0))) == F.lower(F.coalesce(brand, F.lit("")))), F.array_join(F.slice(w, 2, F.size(w)), " ")).otherwise(name))


def head(text: Column) -> Column:
    """The last word."""
    return let(text, lambda t: F.coalesce(F.element_at(F.split(collapse(t), " "), -1), t))


def placeholder(text: Column) -> Column:
    return F.lower(collapse(text)).isin(*dims.PLACEHOLDER_PRODUCTS)


def broad(text: Column) -> Column:
    return let(F.lower(collapse(text)), lambda low: low.isin(*dims.BROAD_CATEGORIES) | head(low).isin(*dims.BROAD_HEADS))


def evidence_text(name: Column, page_class: Column, url: Column, facts: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("product")), page_class, url, F.array_join(F.transform(facts, lambda f: F.coalesce(f["value"], F.lit(""))), " ")))


def category_terms(types: Column, text: Column) -> Column:
    """Terms of each type: those of all hints that the text holds, else the default ones."""

    def own(kind: str) -> Column:
        rules = dims.CATEGORY_TERMS[kind]
        hit = F.flatten(F.array(*[F.when(F.contains(text, F.lit(h)), texts(t)).otherwise(none()) for h, t in rules.items() if h != "default"]))
        return F.when(F.array_contains(types, kind), let(hit, lambda t: F.when(F.size(t) > 0, t).otherwise(texts(rules["default"])))).otherwise(none())

    return unique(F.concat(*map(own, dims.CATEGORY_TERMS)))


def resolved_category(raw: Column, name: Column, short: Column, terms: Column, evidence: Column) -> Column:
    """The stated category unless it says little; then the term best borne out by the evidence (the first of equals), and what else is left."""

    def score(term: Column, joined: Column) -> Column:
        low = F.lower(term)
        return F.when(broad(term), 0).otherwise(3) + F.when(F.contains(term, F.lit(" ")), 1).otherwise(0) + F.when(F.contains(joined, low), 5).when(F.contains(joined, F.lower(head(term))), 2).otherwise(0)

    good = F.filter(F.transform(terms, collapse), lambda t: (t != "") & ~placeholder(t))
    best = lambda g: let(F.lower(F.array_join(evidence, " ")), lambda joined: F.array_max(F.transform(g, lambda t, i: F.struct(score(t, joined).alias("s"), (-i).alias("i"), t.alias("t")))))["t"]
    other = lambda g: F.get(F.filter(g, lambda t: t != name), F.lit(0))
    without = lambda x: let(good, lambda g: F.coalesce(best(g), F.when(x["usable"], x["raw"]), other(g), F.when((short != "") & (short != name) & ~placeholder(short), short), name))
    usable = lambda r: (r != "") & (r != name) & ~placeholder(r)
    said = let(collapse(F.coalesce(raw, F.lit(""))), lambda r: F.struct(r.alias("raw"), usable(r).alias("usable")))
    return let(said, lambda x: F.when(x["usable"] & ~broad(x["raw"]), x["raw"]).otherwise(without(x)))


# -- the whole


def _prefixed(prefix: Column, values: Column, most: int) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.transform(F.slice(values, 1, most), lambda v: F.concat(prefix, F.lit(" "), v))).otherwise(none())


def aliases(name: Column, brand: Column, short: Column, types: Column) -> Column:
    """What a buyer types to find the very product."""
    return unique(F.concat(F.array(name, short, brand, F.when((brand != "") & (short != "") & (short != name), F.concat(brand, F.lit(" "), short))), _prefixed(brand, types, 2)))


def price_bands(amount: Column, types: Column, allowed: Column) -> Column:
    """Both spellings of a price's band of ten thousand won, before each of the first two type phrases."""
    value = F.nullif(F.regexp_replace(F.coalesce(amount, F.lit("")), "[^0-9]", ""), F.lit("")).try_cast("bigint")
    bands = F.when(allowed & value.isNotNull(), K.price_bands(value)).otherwise(none())
    return unique(F.flatten(F.transform(bands, lambda b: F.transform(F.slice(types, 1, 2), lambda t: F.concat(b, F.lit(" "), t)))))


def anchor_tags(facts: Column, page_class: Column, sellability: Column) -> Column:
    own = F.array_distinct(F.filter(F.flatten(F.transform(facts, lambda f: F.coalesce(f["tags"], none()))), lambda t: F.trim(t) != ""))
    return F.array_distinct(F.concat(own, F.when(page_class == "commerce_pdp", F.array(F.lit("commerce"))).otherwise(none()), F.when(sellability == "sellable", F.array(F.lit("sellability"))).otherwise(none())))


def terms_for(types: Column, taxonomy: str) -> Column:
    """Terms of a taxonomy that are allowed for one of the types, in their order."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(types, texts(allowed)), F.lit(term)) for term, allowed in dims.TAXONOMIES[taxonomy].items()]))


def interpreted(packs: DataFrame) -> DataFrame:
    """Packs with the facets, names, categories and permissions that generation reads. One projection after the other, no shuffle."""
    facts, cls = F.col("facts"), F.col("page_class")
    out = packs.withColumn("facts", F.transform(F.coalesce("facts", F.array().cast(packs.schema["facts"].dataType.simpleString())), lambda f: f.withField("tags", F.coalesce(f["tags"], none())).withField("value", F.coalesce(f["value"], F.lit("")))))
    stated = F.when(is_support(cls), F.nullif(first_value(facts, "product_name"), F.lit("")))
    out = out.withColumn("name", clean_title(F.coalesce(stated, F.nullif("product_name", F.lit("")), first_value(facts, "product_name"), "url"), cls))
    fact_brand = F.get(F.filter(values_by_types(facts, ("brand",)), lambda b: F.trim(b) != ""), F.lit(0))
    out = out.withColumns({"brand": product.canonical_brand(fact_brand, F.col("name"), F.col("url")), "evidence_text": evidence_text(F.col("name"), cls, F.col("url"), facts), "direct_texts": direct_texts(facts), **attribute_facets(facts)})
    out = out.withColumns({"short": short_name(F.col("name"), F.col("brand")), "types": product.product_types(F.col("evidence_text")), "tags": anchor_tags(facts, cls, F.col("sellability_state"))})
    out = out.withColumn("category_terms", category_terms(F.col("types"), F.col("evidence_text")))
    raw = F.coalesce(F.nullif(first_value(facts, "product_category"), F.lit("")), F.col("name"))
    out = out.withColumn("category", resolved_category(raw, F.col("name"), F.col("short"), F.col("category_terms"), F.concat(F.array("name", "short"), F.col("direct_texts"))))
    out = out.withColumns(
        {
            "benefits": facet(facts, ("benefit", "award"), ("benefit", "social_proof")),
            "concerns": facet(facts, ("concern", "problem_solution"), ("problem_solution",)),
            "audience": audience(facts),
            "usage": usage(facts),
            "price": first_value(facts, "price"),
            "price_allowed": ~is_support(cls) & (F.col("sellability_state") == "sellable"),
            "value_terms": unique(let(F.transform("direct_texts", F.lower), lambda d: F.filter(texts(dims.VALUE_TERMS), lambda t: F.exists(d, lambda v: F.contains(v, F.lower(t)))))),
            "measures": measures(F.col("specs")),
            "competitors": product.competitor_terms(F.col("types"), F.col("brand"), F.col("url")),
            "events": let(F.lower(F.array_join(F.col("direct_texts"), " ")), lambda low: F.filter(texts(dims.EVENT_TERMS), lambda t: F.contains(low, t))),
            "secondary": F.filter(unique(let(head(F.col("category")), lambda h: F.filter("category_terms", lambda t: head(t) == h))), lambda t: t != F.col("category")),
        }
    )
    out = out.withColumn("type_phrases", unique(F.concat(F.array("category"), F.col("secondary"))))
    compared = mentions(F.col("direct_texts"), F.lit("가격 비교")) | mentions(F.col("direct_texts"), F.lit("price comparison")) | (F.size("measures") >= 2)
    return out.withColumns(
        {
            "aliases": aliases(F.col("name"), F.col("brand"), F.col("short"), F.col("type_phrases")),
            "problem_phrases": unique(F.transform("concerns", lambda c: F.concat(c, F.lit(" "), F.col("category")))),
            "bands": price_bands(F.col("price"), F.col("type_phrases"), F.col("price_allowed")),
            "price_compared": F.col("price_allowed") & compared,
        }
    )
