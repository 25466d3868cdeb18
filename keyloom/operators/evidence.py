"""Evidence of pages: product names, brands, categories, prices and facts from markup and text.

A page is one row (the columns of ``pages.snapshot``) and its facts are one array, so nothing here
shuffles. Facts are structs of type, value, source, tier, tags and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import web
from keyloom.functions.arrays import SPACE, any_in, collapse, first_of_each, let, none, rows_of, stripped, texts, unique, words_of
from keyloom.operators import product

FACT = "struct<type:string,value:string,source:string,tier:string,tags:array<string>,confidence:double>"
#: Text of a page in the order it is read: source, text, bias of confidence.
ENTRY = "struct<source:string,text:string,bias:double>"
_URL_LIKE = r"https?://|www\.|\.html(?:\b|$)"
_MEASURE = r"(?iU)\b[0-9]+\s?(?:" + "|".join(dims.EVIDENCE_UNITS) + r")\b"
_PRICE = r"\$\s?[0-9][0-9,]*원?|(?<![\p{L}\p{N}_])[0-9]{2,3},[0-9]{3}(?![\p{L}\p{N}_])"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(collapse(text), r"^[ \-|/]+|[ \-|/]+$", "")


def url_like(text: Column) -> Column:
    return F.lower(text).rlike(_URL_LIKE)


def is_support(page_class: Column) -> Column:
    return page_class.isin(*dims.SUPPORT_CLASSES)


# -- names, categories, prices


def _up_to_bar(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("|")), trimmed(F.substring_index(text, "|", 1))).otherwise(text)


def _kept_parts(text: Column, stop) -> Column:
    """Parts between " - " up to the first that is to go; the whole text if that leaves nothing."""
    parts = F.filter(F.transform(F.split(text, " - "), F.trim), lambda p: p != "")

    def kept(p: Column) -> Column:
        at = F.array_position(F.transform(p, stop), True).cast("int")
        left = F.when(at == 0, p).otherwise(F.slice(p, 1, F.greatest(at - 1, F.lit(0))))
        return F.when((F.size(p) > 1) & (F.size(left) > 0), trimmed(F.array_join(left, " - "))).otherwise(text)

    return let(parts, kept)


def without_store(text: Column) -> Column:
    """A title without what names the store."""
    stop = lambda p: any_in(F.lower(p), texts(dims.SUPPORT_MARKERS)) | F.lower(p).isin(*dims.STORE_MARKERS)

    def cut(value: Column, left: tuple[str, ...]) -> Column:
        if not left:
            return value
        step = F.when(F.lower(value).endswith(" " + left[0]), trimmed(F.substring(value, F.lit(1), F.length(value) - len(left[0])))).otherwise(value)
        return let(step, lambda v: cut(v, left[1:]))

    return let(_up_to_bar(trimmed(F.coalesce(text, F.lit("")))), lambda t: let(_kept_parts(t, stop), lambda v: cut(v, dims.STORE_MARKERS)))


def clean_name(text: Column, page_class: Column) -> Column:
    """A product's name without store and, on support pages, cut to its model."""

    def cut(value: Column, left: tuple[str, ...]) -> Column:
        if not left:
            return value
        at = F.instr(F.lower(value), left[0])
        return let(F.when(at > 1, trimmed(F.substring(value, F.lit(1), at - 1))).otherwise(value), lambda v: cut(v, left[1:]))

    def model(value: Column) -> Column:
        named = F.coalesce(*[F.nullif(collapse(F.regexp_extract(value, p, 1)), F.lit("")) for p in dims.MODEL_NAMES])
        return F.coalesce(named, F.array_join(F.slice(words_of(value), 1, 4), " "))

    return let(without_store(text), lambda v: F.when(is_support(page_class), let(cut(v, dims.SUPPORT_MARKERS), model)).otherwise(v))


def canonical_name(candidates: list[Column], page_class: Column) -> Column:
    """The first candidate of which something is left."""
    return F.coalesce(*[F.nullif(clean_name(c, page_class), F.lit("")) for c in candidates])


def category(structured: Column, parts: list[Column], page_class: Column) -> Column:
    """The stated category, else the first whose hints the page's names hold, else electronics for support pages."""
    low = F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts], page_class))
    guess = F.when(is_support(page_class), "electronics")
    for name, hints in reversed(dims.CATEGORY_HINTS.items()):
        guess = F.when(any_in(low, texts(hints)), name).otherwise(guess)
    return F.coalesce(F.when(~url_like(structured), F.nullif(structured, F.lit(""))), guess)


def price(structured: Column, text: Column, sellable: Column, page_class: Column) -> Column:
    found = F.nullif(F.regexp_replace(F.replace(F.regexp_extract(text, _PRICE, 0), F.lit(" "), F.lit("")), "원$", ""), F.lit(""))
    return F.when(~is_support(page_class), F.coalesce(F.nullif(structured, F.lit("")), F.when(sellable, found)))


# -- facts of one text


def measurements(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_MEASURE), F.lit(0)), collapse)


def benefits(text: Column) -> Column:
    """Phrases before a verb that claims a benefit, at most six."""
    runs = F.regexp_extract_all(text, F.lit(r"(?iU)([\w\s,/+-]+?)\s*" + dims.BENEFIT_VERBS), F.lit(1))
    runs = F.when(text.rlike("(?i)" + dims.BENEFIT_VERBS), runs).otherwise(none())
    parts = F.transform(F.flatten(F.transform(runs, lambda r: F.split(r, "[,/]"))), collapse)
    ends = lambda p: F.exists(texts(dims.BENEFIT_ENDS), lambda e: F.endswith(p, e))
    good = F.filter(parts, lambda p: (F.length(p) > 1) & ~F.lower(p).isin(*dims.BENEFIT_STOPS) & ~ends(p))
    return unique(F.transform(good, lambda p: F.when(any_in(p, texts(dims.BENEFIT_AREAS)), F.concat(p, F.lit(" improvement"))).otherwise(p)), 6)


def ingredients(text: Column) -> Column:
    return unique(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1)) for p in dims.INGREDIENTS])), 6)


def all_caps(text: Column) -> Column:
    """One to six words of Latin letters, all in capitals."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9.+-]*)"), F.lit(1))
    return let(found, lambda f: (F.size(f) > 0) & (F.size(f) <= 6) & F.forall(f, lambda w: F.upper(w) == w))


def brand_technology(text: Column) -> Column:
    low = F.lower(text)
    named = text.rlike(r"(?U)\b(?:[A-Z]{2,}[A-Za-z0-9.+-]*|\d+D)\b")
    spelt = F.when((F.size(words_of(text)) > 1) & all_caps(text), False).otherwise(named)
    return ~url_like(text) & ~any_in(low, texts(dims.BADGES)) & (any_in(low, texts(dims.TECHNOLOGY_PARTS)) | spelt)


def technologies(text: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(1)) for p in dims.TECHNOLOGIES]))
    return unique(F.filter(F.transform(found, collapse), brand_technology), 4)


def _fact(kind: str, value: Column, source: Column, tags: list[str] | Column, confidence: Column, tier: str = "direct") -> Column:
    tags = texts(tags) if isinstance(tags, list) else tags
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), source.alias("source"), F.lit(tier).alias("tier"), tags.alias("tags"), F.bround(F.greatest(F.lit(0.55), F.least(confidence, F.lit(0.99))), 2).alias("confidence"))


def semantic_facts(text: Column, source: Column, bias: Column) -> Column:
    """Facts that a text states: measures, a variant, benefits, ingredients, technologies, attributes."""

    def made(found: Column, differ: Column) -> Column:
        attribute = F.filter(F.regexp_extract_all(text, F.lit(r"(?iU)\b(" + "|".join(dims.ATTRIBUTE_WORDS) + r")\b"), F.lit(1)), lambda w: ~F.lower(w).isin(*dims.GENERIC_ATTRIBUTES))
        own = F.when(F.size(differ) >= 2, F.array(_fact("variant", F.array_join(F.slice(differ, 1, 3), " / "), source, ["attribute"], bias + 0.84))).otherwise(F.array().cast(f"array<{FACT}>"))
        return F.concat(
            F.transform(F.slice(differ, 1, 4), lambda v: _fact("volume", v, source, ["attribute"], bias + 0.86)),
            own,
            F.transform(benefits(text), lambda v: _fact("benefit", v, source, ["benefit"], bias + 0.84)),
            F.transform(ingredients(text), lambda v: _fact("key_ingredient", v, source, F.when(brand_technology(v), texts(["attribute", "brand_technology"])).otherwise(texts(["attribute", "benefit"])), bias + 0.86)),
            F.transform(technologies(text), lambda v: _fact("attribute", v, source, ["attribute", "brand_technology"], bias + 0.8)),
            F.transform(found, lambda v: _fact("volume", v, source, ["attribute"], bias + 0.8)),
            F.transform(attribute, lambda v: _fact("attribute", collapse(v), source, ["attribute"], bias + 0.8)),
        )

    return let(measurements(text), lambda found: let(unique(found), lambda differ: made(found, differ)))


def facts_of(entries: Column) -> Column:
    """Facts of all entries (source, text, bias), in order."""
    return F.flatten(F.transform(F.filter(entries, lambda e: F.coalesce(e["text"], F.lit("")) != ""), lambda e: semantic_facts(e["text"], e["source"], e["bias"])))


# -- which texts are read


def dropped_block(block: Column, name: Column, brand: Column) -> Column:
    """Whether a block is a badge, a link or a list of a catalogue instead of a statement about the product."""
    # only these characters count as a token of a name here
    marks = F.filter(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"([\\w.+-]+)"), F.lit(1)), lambda t: F.length(t) >= 2)
    scoped = lambda low: ((F.coalesce(brand, F.lit("")) != "") & F.contains(low, F.lower(F.coalesce(brand, F.lit(""))))) | any_in(low, F.transform(marks, F.lower))
    listed = lambda low: let(F.size(F.filter(texts(dims.CATALOG_FORMS), lambda f: F.contains(low, f))), lambda forms: ((forms >= 3) & ~scoped(low)) | (forms >= 5))
    judged = lambda text, low: (F.length(text) <= 1) | low.rlike(_URL_LIKE) | any_in(low, texts(dims.BADGES)) | all_caps(text) | any_in(low, texts(dims.CATALOG_MARKERS)) | listed(low)
    return let(collapse(block), lambda text: let(F.lower(text), lambda low: judged(text, low)))


def _entry(source: Column, text: Column, bias: float) -> Column:
    return F.struct(source.alias("source"), text.alias("text"), F.lit(bias).alias("bias"))


def text_entries(blocks: Column, text: Column, name: Column, brand: Column) -> Column:
    """Blocks worth reading, and the lines of the whole text where the blocks are too few."""
    blocks = F.coalesce(blocks, none())
    numbered = F.filter(F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda x: F.trim(x["b"]) != "")
    own = F.transform(F.filter(numbered, lambda x: ~dropped_block(x["b"], name, brand)), lambda x: _entry(F.concat(F.lit("decoded_text:"), (x["i"] + 1).cast("string")), x["b"], 0.0))
    whole = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(whole, SPACE + "{2,}|\n+"), lambda b, i: F.struct(i.alias("i"), stripped(b).alias("b")))
    read = F.transform(F.filter(lines, lambda x: (x["b"] != "") & ~dropped_block(x["b"], name, brand)), lambda x: _entry(F.concat(F.lit("decoded_fallback:"), (x["i"] + 1).cast("string")), x["b"], -0.02))
    rest = let(read, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(_entry(F.lit("decoded_text"), whole, 0.0))))

    def all_of(entries: Column) -> Column:
        chars = F.aggregate(entries, F.lit(0), lambda n, e: n + F.length(e["text"]))
        sparse = (F.size(entries) == 0) | ((F.size(entries) <= 1) & (F.length(whole) >= 400)) | (chars < F.least(F.lit(180), F.greatest(F.lit(80), F.floor(F.length(whole) / 10))))
        more = F.when(F.size(blocks) == 0, rest).otherwise(first_of_each(F.filter(rest, lambda r: ~F.exists(entries, lambda e: e["text"] == r["text"])), lambda r: r["text"]))
        return F.when((F.trim(whole) != "") & sparse, F.concat(entries, more)).otherwise(entries)

    return let(own, all_of)


# -- all facts of a page


def distinct(facts: Column) -> Column:
    """First fact of each type and value without regard to case."""
    some = F.filter(facts, lambda f: (F.trim(F.coalesce(f["type"], F.lit(""))) != "") & (F.trim(F.coalesce(f["value"], F.lit(""))) != ""))
    return first_of_each(some, lambda f: F.struct(F.lower(F.trim(f["type"])), F.lower(F.trim(f["value"]))))


def with_context(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the product's canonical name, brand, category and price."""
    cls, ld = F.col("page_class"), F.col("ld")
    given = F.coalesce(F.col("given"), F.array().cast(f"array<{FACT}>")) if "given" in snapshots.columns else F.array().cast(f"array<{FACT}>")
    out = snapshots.withColumn("given", given)
    stated = F.get(F.filter("given", lambda f: (f["type"] == "product_name") & (f["tier"] == "direct") & (F.trim(f["value"]) != "")), F.lit(0))["value"]
    out = out.withColumn("canonical_name", canonical_name([stated, ld["fact_name"], F.col("product_name"), F.col("title")], cls))
    return out.withColumns(
        {
            "fact_brand": F.coalesce(F.nullif(ld["fact_brand"], F.lit("")), web.host_brand(F.col("url"))),
            "fact_category": category(ld["fact_category"], [F.col("product_name"), F.col("title"), F.col("meta_description"), F.col("url")], cls),
            "fact_price": price(ld["fact_price"], F.col("text"), (F.col("sellability_state") == "sellable") & (F.size("price") > 0), cls),
        }
    )


def assembled(snapshots: DataFrame) -> DataFrame:
    """Snapshots with ``facts``: given ones, then those of markup, names, category, price, and of all texts read; the first of equal ones stays.

    Optional columns: ``given`` (facts), ``admitted`` and ``direct`` (arrays of recognised texts; direct ones replace admitted ones).
    """
    out = with_context(snapshots)
    ld, cls = F.col("ld"), F.col("page_class")
    empty = F.array().cast(f"array<{FACT}>")
    has = lambda kind: F.exists("given", lambda f: f["type"] == kind)
    one = lambda value, fact: F.when(F.coalesce(value, F.lit("")) != "", F.array(fact)).otherwise(empty)
    described = F.transform(F.coalesce(ld["fact_descriptions"], none()), lambda d: _entry(F.lit("structured_data.description"), d, 0.04))
    named = F.coalesce(F.col("canonical_name"), F.nullif("product_name", F.lit("")), F.nullif("title", F.lit("")))
    has_name, has_brand, has_category = (F.coalesce(ld[f"fact_{k}"], F.lit("")) != "" for k in ("name", "brand", "category"))
    has_price = F.coalesce(ld["fact_price"] == F.col("fact_price"), F.lit(False))
    recognised = [F.coalesce(F.col(c), none()) if c in out.columns else none() for c in ("direct", "admitted")]
    seen = F.when(F.size(recognised[0]) > 0, F.transform(recognised[0], lambda t, i: _entry(F.concat(F.lit("ocr_direct:"), (i + 1).cast("string")), t, -0.03))).otherwise(F.transform(recognised[1], lambda t, i: _entry(F.concat(F.lit("ocr:"), (i + 1).cast("string")), t, -0.08)))
    out = out.withColumn("entries", F.concat(F.array(_entry(F.lit("title"), F.col("title"), 0.06), _entry(F.lit("meta_description"), F.col("meta_description"), 0.05), _entry(F.lit("structured_data.description"), F.array_join(F.coalesce(ld["fact_descriptions"], none()), "\n"), 0.04)), text_entries(F.col("blocks"), F.col("text"), F.col("canonical_name"), F.col("fact_brand")), seen))
    lit = F.lit
    facts = F.concat(
        F.col("given"),
        one(ld["fact_brand"], _fact("brand", ld["fact_brand"], lit("structured_data.brand"), ["product_identity"], lit(0.99))),
        facts_of(described),
        F.when(has("product_name"), empty).otherwise(one(named, _fact("product_name", named, F.when(has_name, "structured_data.name").when(F.col("title").isNotNull(), "title").otherwise("snapshot"), ["product_identity"], lit(0.96)))),
        one(F.col("fact_brand"), _fact("brand", F.col("fact_brand"), F.when(has_brand, "structured_data.brand").otherwise("title_or_host"), ["product_identity"], F.when(has_brand, 0.9).otherwise(0.85))),
        one(F.col("fact_category"), F.when(has_category, _fact("product_category", F.col("fact_category"), lit("structured_data.category"), ["product_identity", "category"], lit(0.93))).otherwise(_fact("product_category", F.col("fact_category"), lit("category_heuristic"), ["product_identity", "category"], lit(0.82), "inferred"))),
        F.when(has("price"), empty).otherwise(one(F.col("fact_price"), _fact("price", F.col("fact_price"), F.when(has_price, "structured_data.offers.price").otherwise("decoded_text"), ["sellability", "commerce"], F.when(has_price, 0.9).otherwise(0.84)))),
        facts_of(F.col("entries")),
    )
    return out.withColumn("facts", F.filter(distinct(facts), lambda f: ~is_support(cls) | (f["type"] != "price") | F.exists("given", lambda g: g["type"] == "price")))


def thin(facts: Column, page_class: Column) -> Column:
    """Whether a commerce page lacks a base fact or has fewer than two kinds of rich facts."""
    kinds = F.array_distinct(F.transform(facts, lambda f: f["type"]))
    count = lambda some: F.size(F.array_intersect(kinds, texts(some)))
    return page_class.isin(*dims.EVIDENCE_COMMERCE) & ((count(dims.BASE_FACTS) < len(dims.BASE_FACTS)) | (count(dims.RICH_FACTS) < 2))


def packs(snapshots: DataFrame) -> DataFrame:
    """Evidence packs: facts with names, counts, states and the reasons of a quality warning."""
    out = assembled(snapshots)
    admitted = F.coalesce(F.col("admitted"), none()) if "admitted" in out.columns else none()
    read = F.aggregate(admitted, F.lit(0), lambda n, t: n + F.length(t))
    name = F.coalesce("canonical_name", "product_name", "url")
    false = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in out.columns else F.lit(False)
    out = out.withColumns({"thin": thin(F.col("facts"), F.col("page_class")), "ocr_used": F.size(admitted) > 0, "ocr_dominant": (read > 0) & (F.col("chars") > 0) & (read / F.greatest(F.col("chars"), F.lit(1)) > 0.3)})
    warnings = product.quality_warnings(false("fallback_used"), false("weak_backfill_used"), F.col("sufficiency"), F.col("page_class"), F.col("thin"), F.col("fallback_reason") if "fallback_reason" in out.columns else None, F.col("text_source"), F.col("ocr_used"), F.col("ocr_dominant"))
    return out.select(
        *[c for c in ("page_id",) if c in out.columns],
        "url",
        "canonical_url",
        "page_class",
        name.alias("product_name"),
        F.coalesce("product_name", "title", "url").alias("display_name"),
        "locale_detected",
        "market_locale",
        "sellability_state",
        "stock_state",
        "sufficiency",
        (F.col("page_class").isin(*dims.WARNING_CLASSES) | F.col("ocr_dominant") | F.col("thin")).alias("quality_warning"),
        false("weak_backfill_used").alias("weak_backfill_used"),
        "thin",
        "facts",
        F.size(F.filter("facts", lambda f: f["tier"] == "direct")).alias("direct_facts"),
        F.size(F.array_distinct(F.transform("facts", lambda f: f["type"]))).alias("fact_groups"),
        warnings.alias("warnings"),
    )


def lifted_facts(answers: Column, sources: Column) -> Column:
    """Facts that a model read off a page: of an allowed type, from a known source, with a quote that stands there.

    ``answers``: array of structs (type, value, source_field, source_quote); ``sources``: map of texts by field.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    source = lambda a: F.try_element_at(sources, text(a["source_field"]))
    quote = lambda a: F.lower(F.coalesce(F.nullif(text(a["source_quote"]), F.lit("")), text(a["value"])))
    good = F.filter(answers, lambda a: text(a["type"]).isin(*dims.LIFTED_TYPES) & (text(a["value"]) != "") & F.coalesce((source(a) != "") & F.contains(F.lower(source(a)), quote(a)), F.lit(False)))
    tag = lambda k: F.when(k.isin("usage", "use_case"), "use_case").when(k.isin("benefit", "problem_solution"), k).otherwise("attribute")
    return F.transform(
        good,
        lambda a: F.struct(text(a["type"]).alias("type"), text(a["value"]).alias("value"), F.concat(F.lit("bedrock_fact_lift:"), text(a["source_field"])).alias("source"), F.lit("direct").alias("tier"), F.array(tag(text(a["type"]))).alias("tags"), F.lit(0.72).alias("confidence")),
    )


def numbered(packs: DataFrame) -> DataFrame:
    """Facts as rows (url, ord, fact_id and the fact's fields), ordinals by arrival."""
    out = rows_of(packs, F.col("facts"), "url", item="f", place="ord")
    return out.select("url", "ord", F.concat(F.lit("f"), F.lpad((F.col("ord") + 1).cast("string"), 3, "0")).alias("fact_id"), "f.*")
