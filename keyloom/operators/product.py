"""Product identity: types, competitors, taxonomy terms, names and interpretation probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.arrays import let
from keyloom.functions.keywords import MEASURE, has_any, holds, tokens, words
from keyloom.functions.web import ordered_distinct, policy_host_brand


def product_types(text: Column) -> Column:
    """Types any hint of which is in the text, in the order of the types; ``general`` if none."""
    low = F.lower(text)
    hit = let(low, lambda x: F.array_compact(F.array(*[F.when(has_any(x, hints), F.lit(t)) for t, hints in dims.PRODUCT_TYPES.items()])))
    return let(hit, lambda h: F.when(F.size(h) == 0, F.array(F.lit("general"))).otherwise(h))


def canonical_brand(fact_brand: Column, product_name: Column, url: Column) -> Column:
    """The fact's brand; but the host's where the fact's is only the first word of the name and the host is no marketplace."""
    first = F.lower(F.substring_index(F.trim(product_name), " ", 1))
    replaced = lambda fact, host: (host != "") & ~F.lower(host).isin(*dims.MARKETPLACES) & (fact != "") & (F.lower(fact) != F.lower(host)) & (first == F.lower(fact))
    return let(F.trim(F.coalesce(fact_brand, F.lit(""))), lambda fact: let(policy_host_brand(url), lambda host: F.when(replaced(fact, host), host).when(fact != "", fact).otherwise(host)))


def competitor_terms(types: Column, brand: Column, url: Column) -> Column:
    """Seeds of the types but for the product's own brand and its host's."""
    table = F.map_from_arrays(F.array(*[F.lit(t) for t in dims.COMPETITORS]), F.array(*[words(v) if v else F.array().cast("array<string>") for v in dims.COMPETITORS.values()]))
    every = F.flatten(F.transform(types, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    own = F.struct(F.lower(F.coalesce(brand, F.lit(""))).alias("brand"), F.lower(policy_host_brand(url)).alias("host"))
    return ordered_distinct(let(own, lambda o: F.filter(every, lambda x: (F.lower(x) != o["brand"]) & (F.lower(x) != o["host"]))))


def domain_mismatch(keyword: Column, types: Column) -> Column:
    return F.array_contains(types, "skincare") & holds(keyword, dims.SKINCARE_BLOCKED)


def valid_competitor(keyword: Column, competitors: Column, identity: Column, categories: Column, types: Column) -> Column:
    """Names another brand, in two tokens or more, with a category term, or the product's identity in a comparison."""
    low = F.lower(F.trim(keyword))
    brand = F.try_element_at(F.filter(competitors, lambda t: F.contains(low, F.lower(t))), F.lit(1))
    known = F.exists(categories, lambda c: F.contains(low, F.lower(c)))
    own = F.exists(identity, lambda t: (F.length(t) >= 2) & F.contains(low, F.lower(t)) & ~F.array_contains(tokens(F.coalesce(brand, F.lit(""))), F.lower(t)))
    compared = has_any(low, ("vs", "비교", "대체", "대안")) | F.array_contains(types, "smartphone")
    size_only = low.rlike(MEASURE) | has_any(low, ("용량 비교", "옵션 비교", "라인 비교", "가격 비교"))
    return F.coalesce(brand.isNotNull() & ~size_only & (F.size(tokens(keyword)) >= 2) & (known | (own & compared)), F.lit(False))


def taxonomy_terms(packs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Terms of each pack (columns key, types, tags): allowed types empty, ``*`` or shared, and all required tags present. Spark sends the smaller side, if it is small enough."""
    t = taxonomy.select("entry_id", "term", F.coalesce("allowed_product_types", F.array().cast("array<string>")).alias("allowed"), F.coalesce("required_anchor_tags", F.array().cast("array<string>")).alias("required"))
    typed = (F.size("allowed") == 0) | F.array_contains("allowed", "*") | F.arrays_overlap("allowed", "types")
    return packs.join(t, typed & (F.size(F.array_except("required", "tags")) == 0)).select("key", "entry_id", "term")


def quality_warnings(fallback: Column, weak: Column, sufficiency: Column, page_class: Column, thin: Column, reason: Column | None = None, text_source: Column | None = None, recognised: Column | None = None, dominant: Column | None = None) -> Column:
    """Ordered reasons for a quality warning; what is not given does not count."""
    no = F.lit(None).cast("string")
    reason, text_source = (no if c is None else F.nullif(c, F.lit("")) for c in (reason, text_source))
    recognised, dominant = (F.lit(False) if c is None else c for c in (recognised, dominant))
    rules = [
        (F.lit("fallback_used"), fallback),
        (F.concat(F.lit("fallback_reason:"), reason), reason.isNotNull()),
        (F.concat(F.lit("preprocessing_source:"), text_source), text_source.isNotNull()),
        (F.lit("weak_backfill_used"), weak),
        (F.lit("borderline_sufficiency"), sufficiency == "borderline"),
        (F.concat(F.lit("page_class:"), page_class), page_class.isin(*dims.WARNING_CLASSES)),
        (F.lit("ocr_used"), recognised),
        (F.lit("ocr_dominant"), dominant),
        (F.lit("thin_pack"), thin),
    ]
    return F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
