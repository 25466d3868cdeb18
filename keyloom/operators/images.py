"""Image candidates of pages and their ranking for text recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.arrays import let, none, rows_of
from keyloom.functions.keywords import has_any
from keyloom.functions.web import unescape

CODELIKE = r"(?U)\b(?:[a-z]{1,3}[0-9]+[a-z0-9]*|[0-9]+[a-z]{1,3}[a-z0-9]*)\b"
_CODELIKE = r"(?:^|[^\p{L}\p{N}_])((?:[a-z]{1,3}[0-9]+[a-z0-9]*|[0-9]+[a-z]{1,3}[a-z0-9]*))(?=[^\p{L}\p{N}_]|$)"


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double or single quotes; null if there is none."""
    start = rf"(?is)(?:^|[\s\"'])" + name + r"\s*=\s*"
    value = let(F.regexp_extract(tag, start + r"\"([^\"]*)\"", 1), lambda v: F.when(v != "", v).otherwise(F.regexp_extract(tag, start + "'([^']*)'", 1)))
    return let(F.trim(unescape(value)), lambda v: F.nullif(v, F.lit("")))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` parts resolved."""
    parts = F.split(path, "/")
    step = lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(p)))
    plain = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), plain).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """A link against its page: absolute, scheme-relative, root-relative or beside the page."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    folder = F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^?#/]*)*)/", 1), F.lit("/"))
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    path = F.regexp_replace(link, r"[?#].*$", "")
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, _without_dots(path), tail)).otherwise(F.concat(root, _without_dots(F.concat(folder, path)), tail))


def _source(value: Column) -> Column:
    """The link of a source attribute: the first of a set, without its width; null for inline data."""
    first = F.when(F.contains(value, F.lit(",")) & (F.contains(value, F.lit("srcset")) | F.contains(value, F.lit(" "))), F.substring_index(value, ",", 1)).otherwise(value)
    link = F.trim(F.substring_index(F.trim(first), " ", 1))
    return F.when((link != "") & ~link.startswith("data:"), link)


def image_candidates(pages: DataFrame, most: int = 30) -> DataFrame:
    """For each ``img`` tag the first source that no tag before it gave, the first ``most`` of a page (columns page_id, url, html).

    What a tag may give depends on those before it, so a page's tags are folded in their order; nothing shuffles.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))
    number = lambda tag, name: F.regexp_extract(F.coalesce(_attribute(tag, name), F.lit("")), "([0-9]+)", 1).try_cast("int")
    link = lambda tag, a: let(_attribute(tag, a), lambda v: let(_source(v), lambda x: resolved(F.col("url"), x)))
    option = lambda tag, a: F.struct(F.lit(a).alias("attribute"), link(tag, a).alias("src"))
    read = F.transform(
        F.coalesce(tags, none()),
        lambda tag, i: F.struct(
            i.alias("dom_index"),
            F.coalesce(_attribute(tag, "alt"), F.lit("")).alias("alt"),
            number(tag, "width").alias("width"),
            number(tag, "height").alias("height"),
            F.filter(F.array(*[option(tag, a) for a in dims.IMAGE_SOURCES]), lambda o: o["src"].isNotNull()).alias("options"),
        ),
    )
    made = "array<struct<dom_index:int,src:string,alt:string,attribute:string,width:int,height:int>>"

    def step(out: Column, t: Column) -> Column:
        new = F.filter(t["options"], lambda o: ~F.exists(out, lambda p: p["src"] == o["src"]))
        take = lambda o: F.struct(t["dom_index"].alias("dom_index"), o["src"].alias("src"), t["alt"].alias("alt"), o["attribute"].alias("attribute"), t["width"].alias("width"), t["height"].alias("height"))
        return F.when(F.size(out) < most, F.concat(out, F.slice(F.transform(new, take), 1, 1))).otherwise(out)

    out = pages.select("page_id", "url", read.alias("read"))
    out = rows_of(out, F.aggregate("read", F.array().cast(made), step), "page_id").select("page_id", "x.*")
    return out.withColumn("detail_hint", (F.col("attribute") != "src") | has_any(F.lower("src"), dims.DETAIL_PATHS))


def _both() -> Column:
    return F.concat(F.lower("src"), F.lit(" "), F.lower("alt"))


def candidate_type() -> Column:
    w, h = F.col("width"), F.col("height")
    return (
        F.when((w > 0) & (h > 0) & (h >= F.greatest(w * 2.2, F.lit(1200))), "long_detail_banner")
        .when(has_any(_both(), dims.TABLE_IMAGES) | (F.size(F.regexp_extract_all(_both(), F.lit(_CODELIKE), F.lit(1))) >= 2), "table_like_image")
        .when(has_any(_both(), dims.FRONT_LABELS), "front_label_closeup")
        .when((w > 0) & (h > 0) & F.col("detail_hint") & (F.greatest(w, h) <= 1100), "front_label_closeup")
        .otherwise("general_detail_image")
    )


def reject_reason() -> Column:
    src, table = F.lower("src"), F.col("candidate_type") == "table_like_image"
    w, h = F.col("width"), F.col("height")
    ends = F.lit(False)
    for e in dims.REJECT_EXTENSIONS:
        ends = ends | src.endswith(e)
    return (
        F.when(has_any(_both(), dims.REJECT_IMAGES), "decorative_asset")
        .when(has_any(_both(), dims.REJECT_TEMPLATES), "templated_asset_url")
        .when(ends, "non_ocr_image_format")
        .when(has_any(_both(), dims.REJECT_HOSTS), "remote_ui_asset")
        .when(F.contains(src, F.lit("/web/upload/images/")) & ~table, "decorative_path_asset")
        .when(has_any(src, dims.REJECT_PATHS) & ~table & ~F.col("detail_hint"), "decorative_path_asset")
        .when(w.isNotNull() & h.isNotNull() & ((w < 300) | (h < 300)), "below_min_dimensions")
        .when((w.isNotNull() & h.isNull() & (w < 80)) | (h.isNotNull() & w.isNull() & (h < 80)), "below_min_known_dimension")
    )


def text_density() -> Column:
    """Hundredths, 15 to 100."""
    kind = F.col("candidate_type")
    points = F.when(kind == "table_like_image", 55).when(kind == "long_detail_banner", 35).when(kind == "front_label_closeup", 25).otherwise(0)
    points = points + F.when(has_any(_both(), dims.SPEC_TOKENS), 20).otherwise(0) + F.when(has_any(_both(), dims.FRONT_LABELS), 12).otherwise(0)
    points = points + F.when(F.coalesce(F.least("width", "height"), F.lit(0)) >= 900, F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), 8).otherwise(0)).otherwise(0)
    return F.least(F.lit(100), points + 15)


def ranked_images(candidates: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Scores and ranks the admitted candidates of a page; ``tokens``: an array of the page's product tokens in lower case."""
    c = candidates.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy("dom_index")) - 1)
    c = c.withColumn("candidate_type", candidate_type()).withColumn("rejected", reject_reason()).where("rejected is null").withColumn("density", text_density())
    area = F.col("width").cast("long") * F.col("height")
    known = (F.col("width") > 0) & (F.col("height") > 0)
    overlap = F.lit(0) if tokens is None else F.size(F.filter(tokens, lambda t: F.contains(_both(), t)))
    kind = F.col("candidate_type")
    score = (
        F.when(known, F.when(area >= 90000, F.least(area / 1000000, F.lit(1.5))).otherwise(0.0)).otherwise(0.25)
        + F.when(has_any(_both(), dims.PRIORITY_IMAGES), 0.35).otherwise(0.0)
        + F.when(F.col("detail_hint") | has_any(F.lower("src"), dims.DETAIL_PATHS), 1.4).otherwise(0.0)
        + F.when(F.lower("attribute") != "src", 0.2).otherwise(0.0)
        + F.when(F.lower("src").endswith(".webp"), 0.15).otherwise(0.0)
        + F.least(overlap * 0.18, F.lit(0.72))
        + F.greatest(F.lit(0.0), F.lit(0.15) - F.col("position") * 0.02)
        + F.col("density") / 100 * 0.45
        + F.when(kind == "long_detail_banner", 0.45).when(kind == "table_like_image", 0.55).when(kind == "front_label_closeup", 0.25).otherwise(0.0)
    )
    c = c.withColumn("score", F.bround(score, 4))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "src")))


def trigger_reasons(chars: Column, charset_confidence: Column, page_class: Column, has_detail: Column, alt_hit: Column) -> Column:
    rules = [("thin_visible_text", F.coalesce(chars, F.lit(0)) < 1500), ("low_charset_confidence", F.coalesce(charset_confidence, F.lit(1.0)) < 0.8), ("image_heavy_page", page_class == "image_heavy_commerce_pdp"), ("image_alt_product_text", alt_hit), ("detail_image_candidate", has_detail)]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
