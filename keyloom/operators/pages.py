"""Page snapshots and their classification. Everything about a page is one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import structured, web
from keyloom.functions.arrays import any_in, texts
from keyloom.workers import ready

_SIGNALS = (("buy", dims.BUY), ("stock", dims.STOCK), ("promo", dims.PROMO), ("support", dims.SUPPORT), ("download", dims.DOWNLOAD), ("waiting", dims.WAITING))
#: Visible characters from which a cleaned page replaces the raw one.
LEAST_CLEANED = 60


def described(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html and any other columns) with what their markup says: title, description, names, language, JSON-LD signals and text."""
    html, url = F.col("html"), F.col("url")
    out = ready(pages).withColumns(
        {
            "ld": structured.structured_signals(structured.json_ld_texts(html)),
            "raw_title": web.title(html),
            "og_title": web.meta(html, "og:title", "property"),
            "raw_description": F.coalesce(web.meta(html, "description"), web.meta(html, "og:description", "property")),
            "meta_locale": web.meta(html, "og:locale", "property"),
            "lang": web.page_language(html),
            "canonical_tag": web.canonical_link(html),
            "canonical_url": web.canonical_url(url),
            "text": web.visible_text(html),
        }
    )
    out = out.withColumn("title", structured.resolved_title(F.col("raw_title"), F.col("og_title"), F.col("ld.name")))
    out = out.withColumn("meta_description", F.coalesce("raw_description", "ld.description"))
    out = out.withColumn("product_name", F.coalesce("ld.name", "og_title", "title", url))
    locale = F.coalesce("lang", F.when(F.contains(F.lower(F.coalesce("meta_locale", F.lit(""))), F.lit("ko")), "ko").otherwise("en"))
    return out.withColumns({"locale_detected": locale, "market_locale": F.coalesce("meta_locale", "lang", F.lit("en"))})


def _signalled(out: DataFrame, tokens: Column, has_schema: Column, lang: Column) -> DataFrame:
    """Signals, scores and states from title, description and ``text`` of described pages."""
    out = out.withColumn("lowered", F.lower(F.concat_ws(" ", "title", "meta_description", "text")))
    low = F.col("lowered")
    out = out.withColumns(
        {
            "chars": F.length("text"),
            "tokens": tokens,
            "has_schema": has_schema,
            "price": web.price_hits(low),
            "blocker": F.concat(web.hits(low, dims.BLOCKER), web.hits(F.lower("html"), dims.BLOCKER_HTML)),
            **{name: web.hits(low, patterns) for name, patterns in _SIGNALS},
            **dict(zip(("hangul", "latin"), web.language_counts(F.col("text")), strict=True)),
        }
    )
    letters = F.greatest(F.col("hangul") + F.col("latin"), F.lit(1))
    korean = F.bround(F.col("hangul") / letters, 4)
    out = out.withColumns(
        {
            "ko": F.when(F.coalesce(lang.startswith("ko"), F.lit(False)), F.greatest(korean, F.lit(0.6))).otherwise(korean),
            "en": F.bround(F.col("latin") / letters, 4),
            "confidence": confidence(F.col("has_schema")),
            "sellability": sellability(),
            "sellability_state": F.when(_some("price") | _some("buy"), "sellable").otherwise("non_sellable"),
            "stock_state": stock_state(),
            "sufficiency": F.when(F.col("chars") >= 400, "sufficient").otherwise("borderline"),
            **{f"{name}_density": density(name) for name in ("promo", "support", "download")},
        }
    )
    return out.withColumn("page_class", page_class(F.col("has_schema")))


def snapshot(pages: DataFrame) -> DataFrame:
    """One row per page: what its markup says, signals, counts, scores, states and class. One scan, no shuffle."""
    out = described(pages).withColumn("blocks", web.blocks(F.col("text")))
    tokens = web.product_tokens(F.col("title"), F.col("meta_description"), F.col("product_name"), F.col("ld.brand"))
    return _signalled(out, tokens, F.col("ld.has_product"), F.col("lang")).withColumn("text_source", F.lit("raw_html"))


def preprocessed_snapshot(pages: DataFrame) -> DataFrame:
    """The snapshot of a page rendered again, with a column ``cleaned_html``: its text replaces the raw one where enough of it is visible; markup is read from the raw page."""
    out = described(pages).withColumn("cleaned", web.visible_text(F.trim(F.coalesce("cleaned_html", F.lit("")))))
    use = F.length("cleaned") >= LEAST_CLEANED
    out = out.withColumn("text_source", F.when(use, "cleaned_html").otherwise("raw_html")).withColumn("text", F.when(use, F.col("cleaned")).otherwise(F.col("text"))).drop("cleaned")
    out = out.withColumn("blocks", web.blocks(F.col("text")))
    tokens = web.product_tokens(F.col("title"), F.col("meta_description"), F.col("product_name"))
    return _signalled(out, tokens, F.col("ld.payloads") > 0, F.col("locale_detected"))


def _some(name: str) -> Column:
    return F.size(name) > 0


def density(name: str) -> Column:
    """Signals for each visible character, to six places."""
    return F.when(F.col("chars") > 0, F.bround(F.size(name) / F.col("chars"), 6)).otherwise(F.lit(0.0))


def confidence(has_schema: Column) -> Column:
    """Confidence that a page is about one product, 0.15 to 0.95; summed in this order, so that thresholds meet the same doubles everywhere."""
    words = F.size(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit("([A-Za-z0-9가-힣]+)"), F.lit(1)))
    named = F.lower(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("product_name", F.lit(""))))
    hero = named.rlike(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(dims.HERO_NOUNS) + r")(?:[^\p{L}\p{N}_]|$)")
    points = [
        F.when(words >= 2, 0.12),
        F.when((F.coalesce("product_name", F.lit("")) != "") & (F.coalesce(F.col("product_name") != F.col("title"), F.lit(True))), 0.08),
        F.when(any_in(F.lower("url"), texts(dims.PRODUCT_URL)), 0.18),
        F.when(has_schema, 0.25),
        F.when(_some("tokens"), 0.1),
        F.when(hero, 0.12),
        F.when(_some("price") & _some("buy"), 0.15).when(_some("price") | _some("buy"), 0.08),
        F.when(F.col("chars") > 800, 0.05),
    ]
    total = F.lit(0.15)
    for p in points:
        total = total + p.otherwise(0.0)
    return F.least(total, F.lit(0.95))


def sellability() -> Column:
    total = F.when(_some("price"), 0.45).otherwise(0.0) + F.when(_some("buy"), 0.35).otherwise(0.0) + F.when(_some("stock"), 0.1).otherwise(0.0)
    return F.least(total, F.lit(0.95))


def stock_state() -> Column:
    gone = F.array_contains("stock", "out of stock") | F.array_contains("stock", "품절")
    return F.when(gone, "OutOfStock").when(_some("stock"), "InStock").otherwise("Unknown")


def page_class(has_schema: Column) -> Column:
    """The ordered class rules over a snapshot's columns; the first that holds wins."""
    title, url = F.lower(F.coalesce("title", F.lit(""))), F.lower("url")
    helps = any_in(title, texts(dims.SUPPORT_TITLE)) | F.contains(url, F.lit("support.apple.com"))
    landing = any_in(url, texts(dims.LANDING_URL))
    price, buy = _some("price"), _some("buy")
    strong = (F.col("confidence") >= 0.65) | (has_schema & (price | buy)) | (price & buy & (F.col("confidence") >= 0.55) & ~landing)
    low = F.col("lowered")
    links = F.length(low) - F.length(F.replace(low, F.lit("/products/"), F.lit("")))
    return (
        F.when(_some("blocker"), "blocked_page")
        .when(_some("waiting"), "waiting_page")
        .when(helps & _some("support") & (F.size("download") >= 3), "document_download_heavy_support_page")
        .when(helps & _some("support"), "support_spec_page")
        .when(strong & price & buy & (F.col("chars") < 2500), "image_heavy_commerce_pdp")
        .when(strong & (price | buy), "commerce_pdp")
        .when(_some("promo") & ~strong & (landing | (F.size("promo") >= 2)), "promo_heavy_commerce_landing")
        .when(F.contains(low, F.lit("__nuxt__={};")) | (F.col("chars") < 250) | (links > 8 * len("/products/")), "non_product_page")
        .when(F.contains(url, F.lit("/shop/")) | F.contains(url, F.lit("/product/")), "marketing_only_pdp")
        .when(title != "", "product_marketing_page")
        .otherwise("non_product_page")
    )


def gated(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the supported gate: class confidence, failure code and quality warning."""
    ok = F.col("page_class").isin(*dims.SUPPORTED_CLASSES)
    return snapshots.withColumns({"supported": ok, "failure_code": F.when(~ok, F.col("page_class")), "quality_warning": F.col("page_class").isin(*dims.WARNING_CLASSES)})


def classified(pages: DataFrame) -> DataFrame:
    """Snapshot with its class and the supported gate."""
    return gated(snapshot(pages))


def fallback_reason(rendered: Column | None = None, least_chars: int = 1200) -> Column:
    """Why a page is fetched again by a browser, or null; a page that was rendered already is not."""
    bare = (F.col("ld.payloads") == 0) & ~_some("price") & ~_some("buy")
    weak = F.col("page_class").isin("non_product_page", "promo_heavy_commerce_landing")
    thin = (F.col("chars") < least_chars) & (F.col("ld.payloads") == 0) & (~_some("price") | ~_some("buy"))
    return (
        F.when(F.lit(False) if rendered is None else rendered, F.lit(None).cast("string"))
        .when(F.col("page_class").isin("blocked_page", "waiting_page"), "blocked_or_waiting_surface")
        .when(weak & bare, "client_side_render_suspected")
        .when(weak, "thin_product_evidence")
        .when(thin, "thin_product_evidence")
    )


def _by_text(error: Column, rules: tuple) -> list[Column]:
    low = F.lower(F.coalesce(error, F.lit("")))
    return [F.when(any_in(low, texts(parts)), F.lit(hint)) for parts, hint in rules]


def fetch_hints(error: Column, rendered: Column) -> Column:
    """Hints of a page that could not be fetched, by its error text."""
    return F.array_compact(F.array(*_by_text(error, dims.FETCH_HINTS), F.when(rendered, dims.RENDERED_HINT).otherwise(dims.PLAIN_HINT)))


def snapshot_hints(flags: Column, status: Column) -> Column:
    first, damaged, failed = dims.SNAPSHOT_HINTS
    return F.array_compact(F.array(F.lit(first), F.when(F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0, damaged), F.when(status >= 400, failed)))


def recognition_hints(error: Column) -> Column:
    return F.array_compact(F.array(F.lit(dims.RECOGNITION_HINT), *_by_text(error, dims.RECOGNITION_HINTS)))


def failure_hints() -> Column:
    """Ordered hints of a page whose class is not supported; null if it is."""
    cls = F.col("page_class")
    own = F.array(F.concat(cls, F.lit(dims.OTHER_CLASS_HINT)))
    for name, hints in dims.CLASS_HINTS.items():
        own = F.when(cls == name, texts(hints)).otherwise(own)
    more = F.array_compact(F.array(F.when(F.col("ld.payloads") == 0, dims.NO_DATA_HINT), F.when(~_some("buy"), dims.NO_BUY_HINT)))
    return F.when(~F.col("supported"), F.concat(own, more))
