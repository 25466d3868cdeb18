"""Text recognised in images: which blocks are admitted, how lines group, what counts as direct evidence, and recognition passes.

Blocks are rows (page_id, ord, text, source, image_src, candidate_type, pipeline_type,
preprocessing_variant, tile_mode, tile_index, block_order); pages give product_name, tokens, text and
page_class. They meet by one join on page_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.arrays import any_in, collapse, none, rows_of, texts
from keyloom.functions.tables import spread
from keyloom.operators.images import CODELIKE

MEASURE = r"(?iU)\b\d+(?:\.\d+)?\s?(?:" + "|".join(dims.RECOGNITION_UNITS) + r")\b"
_TERMS = "([A-Za-z가-힣]{4,})"
_WORDS = "([A-Za-z0-9가-힣]+)"
_NAMES = "([A-Za-z0-9가-힣.+-]{2,})"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def token_set(tokens: Column, product_name: Column) -> Column:
    """Words that name the product, in lower case."""
    every = F.concat(F.coalesce(tokens, none()), _found(F.coalesce(product_name, F.lit("")), _NAMES))
    return F.array_distinct(F.filter(F.transform(every, F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(*dims.COMMON_WORDS)))


def matching(tokens: Column, text: Column) -> Column:
    return F.sort_array(F.filter(tokens, lambda t: (t != "") & F.contains(F.lower(text), t)))


def product_field(text: Column) -> Column:
    """Whether a text names a field of a product label."""
    return any_in(F.lower(text), texts(dims.PRODUCT_FIELDS))


def specified(text: Column) -> Column:
    return text.rlike(MEASURE) | any_in(F.lower(text), texts(dims.SPEC_TOKENS))


def _processed(variant: Column) -> Column:
    return ~F.coalesce(variant, F.lit("")).isin("", "original")


def text_quality(text: Column, matched: Column, pipeline: Column, variant: Column) -> Column:
    total = F.least(F.length(text) / 120.0, F.lit(0.55)) + F.least(F.size(matched) * 0.14, F.lit(0.28))
    for holds, points in ((any_in(F.lower(text), texts(dims.SPEC_TOKENS)), 0.12), (text.rlike(MEASURE), 0.12), (F.size(_found(text, _TERMS)) >= 2, 0.08), (F.coalesce(pipeline == "structured_table", F.lit(False)), 0.08), (_processed(variant), 0.03)):
        total = total + F.when(holds, points).otherwise(0.0)
    return F.bround(F.least(total, F.lit(1.0)), 4)


def same_product(text: Column, matched: Column, name: Column, page_class: Column, kind: Column) -> Column:
    low, name = F.lower(text), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    terms = F.filter(_found(name, _NAMES), lambda t: F.length(t) >= 4)
    shared = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    field = product_field(text)
    total = F.when(F.size(matched) > 0, F.least(F.size(matched) * 0.18 + 0.3, F.lit(0.72))).otherwise(0.0)
    total = total + F.when((name != "") & F.contains(low, name), 0.25).otherwise(0.0) + F.least(shared * 0.08, F.lit(0.2))
    total = total + F.when(field, 0.28).otherwise(0.0) + F.when(field & page_class.isin(*dims.COMMERCE_CLASSES), 0.08).otherwise(0.0)
    total = total + F.when(field & kind.isin("front_label_closeup", "long_detail_banner", "table_like_image"), 0.06).otherwise(0.0)
    return F.bround(F.least(total, F.lit(1.0)), 4)


def layout_trust(kind: Column, pipeline: Column, tile_mode: Column, variant: Column) -> Column:
    total = F.when(kind == "table_like_image", 0.85).when(kind == "long_detail_banner", 0.74).when(kind == "front_label_closeup", 0.8).otherwise(0.66)
    total = total + F.when(pipeline == "structured_table", 0.08).otherwise(0.0) + F.when(tile_mode == "vertical", 0.05).otherwise(0.0) + F.when(_processed(variant), 0.03).otherwise(0.0)
    return F.bround(F.least(total, F.lit(1.0)), 4)


def numeric_junk(text: Column) -> Column:
    chars = _found(text, "([A-Za-z0-9가-힣])")
    n = F.greatest(F.size(chars), F.lit(1))
    share = F.size(F.filter(chars, lambda c: c.rlike("[0-9]"))) / n
    return (F.size(chars) == 0) | (share > 0.85) | ((share > 0.7) & (F.size(F.array_distinct(chars)) <= F.greatest(F.lit(6), F.floor(n / 2))))


def brand_repetition(text: Column, tokens: Column) -> Column:
    words = _found(F.lower(text), _WORDS)
    differ = F.array_distinct(words)
    return (F.size(words) >= 3) & ((F.size(differ) == 1) | ((F.size(differ) == 2) & F.arrays_overlap(differ, tokens)))


def repeats_page(text: Column, page_text: Column) -> Column:
    low = F.lower(collapse(text))
    return (F.length(low) >= 24) & F.contains(F.lower(collapse(F.coalesce(page_text, F.lit("")))), low)


def worth_keeping(text: Column, matched: Column, source: Column, kind: Column) -> Column:
    """Whether a short text of an image says enough."""
    terms = _found(text, _TERMS)
    says = (F.size(matched) > 0) | (F.size(terms) >= 2) | ((F.size(terms) == 1) & (F.length(F.get(terms, F.lit(0))) >= 8)) | text.rlike(MEASURE)
    return F.coalesce(source == "image", F.lit(False)) & (says | (F.coalesce(kind == "table_like_image", F.lit(False)) & text.rlike("(?i)" + CODELIKE)))


def unrelated_names(text: Column, matched: Column, source: Column, tokens: Column) -> Column:
    named = F.array_distinct(F.filter(_found(text, "([A-Za-z][A-Za-z0-9.+-]{2,})"), lambda t: ~F.array_contains(tokens, F.lower(t))))
    return ~F.coalesce(source == "image", F.lit(False)) & (F.size(matched) == 0) & (F.size(named) >= 2)


def rejection(text: Column, matched: Column, tokens: Column, page_text: Column, source: Column, kind: Column) -> Column:
    """The first reason against a block, or null."""
    enough = (F.length(text) >= 30) | (F.size(matched) >= 2) | product_field(text) | worth_keeping(text, matched, source, kind)
    return (
        F.when(text == "", "empty_text")
        .when(numeric_junk(text), "mostly_numeric_junk")
        .when(brand_repetition(text, tokens), "brand_only_repetition")
        .when(repeats_page(text, page_text), "duplicate_of_direct_html")
        .when(~enough, "too_short_without_product_tokens")
        .when(unrelated_names(text, matched, source, tokens), "unrelated_product_names")
        .when(any_in(F.lower(text), texts(dims.PROMO_WORDS)) & (F.size(matched) == 0), "promo_not_tied_to_product")
    )


def direct_evidence(text: Column, kind: Column, product: Column, quality: Column, trust: Column) -> Column:
    plain = (product >= 0.45) & (quality >= 0.35) & (trust >= 0.6)
    labelled = product_field(text) & (product >= 0.28) & (quality >= 0.18) & (trust >= 0.6)
    return plain | labelled | (F.coalesce(kind == "table_like_image", F.lit(False)) & (trust >= 0.8) & specified(text))


def judged(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with matched tokens, three scores, their blend, the reason against them and whether they are direct evidence."""
    page = pages.select("page_id", F.col("product_name").alias("page_name"), "tokens", F.col("text").alias("page_text"), "page_class")
    out = blocks.join(spread(page), "page_id").withColumn("text", collapse(F.coalesce("text", F.lit("")))).withColumn("own_tokens", token_set(F.col("tokens"), F.col("page_name")))
    out = out.withColumn("matched", matching(F.col("own_tokens"), F.col("text")))
    c, kind = F.col, F.coalesce("candidate_type", F.lit("general_detail_image"))
    out = out.withColumns(
        {
            "text_quality": text_quality(c("text"), c("matched"), c("pipeline_type"), c("preprocessing_variant")),
            "same_product": same_product(c("text"), c("matched"), c("page_name"), c("page_class"), kind),
            "layout_trust": layout_trust(kind, c("pipeline_type"), c("tile_mode"), c("preprocessing_variant")),
            "rejected": rejection(c("text"), c("matched"), c("own_tokens"), c("page_text"), c("source"), c("candidate_type")),
        }
    )
    direct = c("rejected").isNull() & direct_evidence(c("text"), c("candidate_type"), c("same_product"), c("text_quality"), c("layout_trust"))
    out = out.withColumns({"score": F.bround(c("text_quality") * 0.45 + c("same_product") * 0.35 + c("layout_trust") * 0.2, 4), "direct": direct})
    return out.drop("page_name", "tokens", "page_text", "page_class", "own_tokens")


def line_groups(admitted: DataFrame, most: int = 3, chars: int = 96, short: int = 32) -> DataFrame:
    """Up to three short blocks in a row of a tile become one line, but not in tables: a fold over each tile's ordered blocks.

    Columns: page_id, image_src, tile_index, group_no, ordinal (over the page, from 1), text, blocks, candidate_type, matched,
    the largest of each score, and whether it is direct evidence.
    """
    c = F.col
    place = F.struct(F.coalesce("block_order", F.lit(0)).alias("o"), (~c("direct")).alias("d"), (-c("score")).alias("s"), c("text").alias("t"))
    item = F.struct(place.alias("place"), "text", "candidate_type", "pipeline_type", "preprocessing_variant", "matched", "text_quality", "same_product", "layout_trust", "direct")
    listed = admitted.groupBy("page_id", F.coalesce("image_src", F.lit("")).alias("image_src"), F.coalesce("tile_index", F.lit(0)).alias("tile_index")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = listed.schema["items"].dataType.simpleString()

    def step(groups: Column, x: Column) -> Column:
        last = F.coalesce(F.get(groups, F.size(groups) - 1), F.array().cast(kind))
        length = F.length(F.trim(F.array_join(F.transform(last, lambda b: b["text"]), " ")))
        small = F.forall(last, lambda b: F.length(b["text"]) <= short) & (F.length(x["text"]) <= short)
        joins = (F.size(last) > 0) & (F.size(last) < most) & small & (length + F.length(x["text"]) <= chars) & (F.coalesce(F.get(last, F.lit(0))["candidate_type"], F.lit("")) != "table_like_image")
        return F.when(joins, F.concat(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.concat(last, F.array(x))))).otherwise(F.concat(groups, F.array(F.array(x))))

    folded = F.aggregate("items", F.array().cast(f"array<{kind}>"), step)
    out = rows_of(listed.withColumn("folded", folded), F.col("folded"), "page_id", "image_src", "tile_index", item="g", place="group_no")
    top = lambda name: F.array_max(F.transform("g", lambda b: b[name]))
    head = F.get(F.col("g"), F.lit(0))
    out = out.select(
        "page_id",
        "image_src",
        "tile_index",
        "group_no",
        F.trim(F.array_join(F.filter(F.transform("g", lambda b: b["text"]), lambda t: t != ""), " ")).alias("text"),
        F.size("g").alias("blocks"),
        head["candidate_type"].alias("candidate_type"),
        head["pipeline_type"].alias("pipeline_type"),
        head["preprocessing_variant"].alias("preprocessing_variant"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("g", lambda b: b["matched"])))).alias("matched"),
        top("text_quality").alias("text_quality"),
        top("same_product").alias("same_product"),
        top("layout_trust").alias("layout_trust"),
        F.exists("g", lambda b: b["direct"]).alias("any_direct"),
    )
    out = out.withColumn("text_quality", F.greatest("text_quality", text_quality(c("text"), c("matched"), c("pipeline_type"), c("preprocessing_variant"))))
    out = out.withColumn("direct", c("any_direct") | direct_evidence(c("text"), c("candidate_type"), c("same_product"), c("text_quality"), c("layout_trust"))).drop("any_direct")
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("page_id").orderBy("image_src", "tile_index", "group_no")))


def direct_candidates(groups: DataFrame) -> DataFrame:
    """Line groups that become facts, with an id by their ordinal (gaps stay)."""
    c = F.col
    tied = ~(any_in(F.lower("text"), texts(dims.PROMO_WORDS)) & (F.size("matched") == 0))
    sure = (c("same_product") >= 0.45) | (F.coalesce(c("candidate_type") == "table_like_image", F.lit(False)) & specified(c("text"))) | (product_field(c("text")) & (c("same_product") >= 0.28))
    return groups.where(c("direct") & (c("text") != "") & tied & sure).withColumn("candidate_id", F.concat(F.lit("ocr_direct_"), F.lpad(c("ordinal").cast("string"), 3, "0")))


def image_results(ranked: DataFrame, results: DataFrame) -> DataFrame:
    """Ranked images with what an earlier recognition gave (left join by page and source); its values come before the candidate's."""
    r = results.where(F.trim("image_src") != "").select("page_id", F.col("image_src").alias("src"), *[F.col(n).alias("r_" + n) for n in ("image_attribute", "candidate_type", "engine_used", "tile_count", "status", "raw_block_count", "raw_char_count", "runtime_ms", "error")])
    out = ranked.join(spread(r), ["page_id", "src"], "left")
    zero = lambda n: F.coalesce("r_" + n, F.lit(0)).alias(n)
    return out.select(
        "page_id",
        F.col("src").alias("image_src"),
        F.coalesce("r_image_attribute", "attribute").alias("image_attribute"),
        F.coalesce("r_candidate_type", "candidate_type", F.lit("general_detail_image")).alias("candidate_type"),
        F.col("r_engine_used").alias("engine_used"),
        F.greatest(F.coalesce(F.nullif("r_tile_count", F.lit(0)), F.lit(1)), F.lit(1)).alias("tile_count"),
        F.coalesce("r_status", F.lit("pending")).alias("status"),
        zero("raw_block_count"),
        zero("raw_char_count"),
        zero("runtime_ms"),
        F.col("r_error").alias("error"),
    )


def block_counts(judged_: DataFrame, groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per image: admitted and rejected blocks, line groups, direct candidates, and the mean of same-product scores. One aggregation over a tagged union."""
    tag = lambda d, kind, ok: d.select("page_id", F.coalesce("image_src", F.lit("")).alias("image_src"), F.lit(kind).alias("kind"), ok.alias("value"))
    none_ = F.lit(None).cast("double")
    every = tag(judged_.where("rejected is null"), "admitted", F.col("same_product")).unionByName(tag(judged_.where("rejected is not null"), "rejected", none_)).unionByName(tag(groups, "group", none_)).unionByName(tag(candidates, "direct", none_))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return every.where("image_src != ''").groupBy("page_id", "image_src").agg(n("admitted").alias("admitted"), n("rejected").alias("rejected"), n("group").alias("line_groups"), n("direct").alias("direct_candidates"), F.bround(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean_same_product"))


def decisions(pages: DataFrame, judged_: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per page (page_id, reasons: array): SKIPPED or AVAILABLE, the reasons, and what the admitted blocks come to."""
    ok = F.col("rejected").isNull()
    per = judged_.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("admitted"), F.sum(F.when(ok, F.length("text")).otherwise(0)).alias("chars"), F.bround(F.coalesce(F.avg(F.when(ok, F.col("same_product"))), F.lit(0.0)), 4).alias("mean_same_product"), F.bround(F.coalesce(F.avg(F.when(ok, F.col("text_quality"))), F.lit(0.0)), 4).alias("mean_text_quality"))
    direct = candidates.groupBy("page_id").agg(F.count("*").alias("direct_candidates"))
    out = pages.select("page_id", "reasons").join(spread(per), "page_id", "left").join(spread(direct), "page_id", "left")
    some, asked = F.coalesce(F.col("n"), F.lit(0)) > 0, F.size("reasons") > 0
    extra = lambda *v: F.array(*[F.lit(x) for x in v])
    reasons = F.when(some, F.when(asked, F.col("reasons")).otherwise(extra("fixture_ocr_blocks_present"))).when(asked, F.concat("reasons", extra("no_ocr_blocks_available"))).otherwise(extra("ocr_not_required"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return out.select("page_id", F.when(some, "AVAILABLE").otherwise("SKIPPED").alias("status"), reasons.alias("reasons"), zero("admitted"), zero("chars"), zero("direct_candidates"), F.coalesce("mean_same_product", F.lit(0.0)).alias("mean_same_product"), F.coalesce("mean_text_quality", F.lit(0.0)).alias("mean_text_quality"))


# -- recognition passes

PASS = "array<struct<pipeline_type:string,preprocessing_variant:string,ocr_lang:string,tile_mode:string>>"


def english_heavy(src: Column, alt: Column) -> Column:
    both = F.concat(src, F.lit(" "), F.coalesce(alt, F.lit("")))
    return (F.size(_found(both, "([A-Za-z])")) >= 6) & ~both.rlike("[가-힣]")


def planned_passes(kind: Column, pipeline: Column, src: Column, alt: Column, structured: bool = False, multipass: bool = True, tiling: bool = True, languages: bool = False) -> Column:
    """The passes of an image in their order, each once."""
    one = lambda p, v, lang, tile: F.struct(F.lit(p).alias("pipeline_type"), F.lit(v).alias("preprocessing_variant"), F.lit(lang).alias("ocr_lang"), tile.alias("tile_mode"))
    flat = F.lit("none")
    table = [one("structured_table" if structured else "plain_text", "original", "korean", flat)]
    if structured:
        table.append(one("plain_text", "enhance_contrast" if multipass else "original", "korean", flat))
    tile = F.when(F.lit(tiling) & (kind == "long_detail_banner"), "vertical").otherwise("none")
    plain = [one("plain_text", "original", "korean", tile)]
    if multipass:
        plain += [one("plain_text", "enhance_contrast", "korean", tile), F.when(kind == "front_label_closeup", one("plain_text", "upscale_x2", "korean", tile))]
    if languages:
        plain.append(F.when(english_heavy(src, alt), one("plain_text", "original", "en", tile)))
    return F.array_distinct(F.array_compact(F.when(pipeline == "structured_table", F.array(*table)).otherwise(F.array(*plain)))).cast(PASS)


def best_pass(passes: Column, kind: Column) -> Column:
    """Place of the best pass of an image among those run: they stop at the first that is good enough.

    ``passes``: ordered array of structs with engine_ok, char_count, block_count, pipeline_type and runtime_ms. Better is:
    it worked, more characters, more blocks, structured, then faster, then earlier.
    """
    enough = lambda p: p["engine_ok"] & (
        ((p["pipeline_type"] == "structured_table") & (p["block_count"] >= 6))
        | F.when(kind == "front_label_closeup", (p["char_count"] >= 80) | (p["block_count"] >= 6)).when(kind == "long_detail_banner", (p["char_count"] >= 180) | (p["block_count"] >= 12)).otherwise((p["char_count"] >= 120) | (p["block_count"] >= 8))
    )
    stop = F.array_position(F.transform(passes, lambda p: F.coalesce(enough(p), F.lit(False))), True).cast("int")
    run = F.when(stop > 0, F.slice(passes, F.lit(1), F.greatest(stop, F.lit(1)))).otherwise(passes)
    ranked = F.transform(run, lambda p, i: F.struct(p["engine_ok"].cast("int").alias("ok"), p["char_count"].alias("chars"), p["block_count"].alias("blocks"), (p["pipeline_type"] == "structured_table").cast("int").alias("s"), (-p["runtime_ms"]).alias("fast"), (-i).alias("at")))
    return -F.array_max(ranked)["at"]
