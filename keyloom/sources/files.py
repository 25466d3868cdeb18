"""Readers and writers with declared schemas: snapshots, taxonomies, golden cases, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import dims

TAXONOMY = "entry_id string, term string, normalized_term string, allowed_categories array<string>, allowed_product_types array<string>, required_anchor_tags array<string>, max_evidence_tier string, risk_flags array<string>"
GOLDEN = "case_id string, source_path string, requested_platform_mode string, notes string, platform_expectations map<string, struct<must_keep: array<string>, must_not_emit: array<string>, forbidden_substrings: array<string>, required_categories: array<string>>>"
FACT = "fact_id string, type string, value string, normalized_value string, source string, source_uri string, page_scope string, evidence_tier string, admissibility_tags array<string>, confidence double"
PACK = f"url_task_id string, raw_url string, canonical_url string, page_class string, requested_platform_mode string, sufficiency_state string, quality_warning boolean, facts array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FACT.split(', '))}>>, product_name string"


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, TAXONOMY).where(F.trim(F.coalesce("term", F.lit(""))) != "")


def taxonomies(spark: SparkSession) -> DataFrame:
    """The built-in taxonomies: taxonomy, term, allowed_product_types."""
    return spark.createDataFrame([(g, term, list(types)) for g, terms in dims.TAXONOMIES.items() for term, types in terms.items()], "taxonomy string, term string, allowed_product_types array<string>")


def golden_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Golden cases from JSON texts, in long form."""
    return _golden(payloads.select(F.from_json(column, GOLDEN).alias("c")).select("c.*"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases in long form: case, platform, kind, value."""
    return _golden(read_json(spark, path, GOLDEN))


def _golden(cases: DataFrame) -> DataFrame:
    long = cases.select("case_id", F.explode("platform_expectations").alias("platform", "e"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"e.{k}"), F.array().cast("array<string>")).alias("v")) for k in ("must_keep", "must_not_emit", "forbidden_substrings", "required_categories")]
    return long.select("case_id", "platform", F.explode(F.array(*kinds)).alias("x")).select("case_id", "platform", "x.kind", F.explode("x.v").alias("value"))


def pack_facts(packs: DataFrame) -> DataFrame:
    """Facts of evidence packs in their order, with defaults for absent fields."""
    out = packs.select(F.col("raw_url").alias("url"), F.posexplode("facts").alias("ord", "f")).select("url", "ord", "f.*")
    return out.withColumn("normalized_value", F.coalesce("normalized_value", "value")).withColumn("page_scope", F.coalesce("page_scope", F.lit("exact"))).withColumn("evidence_tier", F.coalesce("evidence_tier", F.lit("direct"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.8)))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*dims.EXPORT_COLUMNS).write.option("header", True).option("emptyValue", "").csv(path)


def write_json(results: DataFrame, path: str) -> None:
    """Nested results, a folder for each job."""
    results.write.partitionBy("job_id").json(path)


#: Columns of a page's snapshot by kind, as JSON holds them: texts, lists of texts, numbers, flags, and lists of objects.
SNAPSHOT_TEXTS = ("final_url", "content_type", "fetch_profile_used", "fetched_at", "charset_selected", "meta_locale", "title", "meta_description", "canonical_tag", "decoded_text", "locale_detected", "market_locale", "sellability_state", "stock_state", "sufficiency_state", "fallback_reason", "preprocessing_source")
SNAPSHOT_LISTS = ("mojibake_flags", "visible_text_blocks", "breadcrumbs", "primary_product_tokens", "price_signals", "buy_signals", "stock_signals", "promo_signals", "support_signals", "download_signals", "blocker_signals", "waiting_signals", "ocr_trigger_reasons")
SNAPSHOT_NUMBERS = {"http_status": "int", "usable_text_chars": "int", "charset_confidence": "double", "single_product_confidence": "double", "sellability_confidence": "double", "support_density": "double", "download_density": "double", "promo_density": "double"}
SNAPSHOT_FLAGS = ("quality_warning", "fallback_used", "weak_backfill_used")
IMAGE = "src string, alt string, attribute string, dom_index int, detail_hint boolean, width int, height int"
BLOCK = "text string, source string, image_src string, image_attribute string, image_score double, candidate_type string, pipeline_type string, engine_used string, recognizer_lang string, preprocessing_variant string, tile_mode string, tile_index int, block_order int"
PASS = "pipeline_type string, preprocessing_variant string, recognizer_lang string, tile_mode string, engine_used string, block_count int, char_count int, tile_count int, runtime_ms int, engine_ok boolean, error string"
_fields = lambda ddl: "struct<" + ", ".join(f.replace(" ", ": ", 1) for f in ddl.split(", ")) + ">"
IMAGE_RESULT = "struct<image_src: string, status: string, raw_block_count: int, raw_char_count: int, runtime_ms: int, error: string, ocr_passes: array<" + _fields(PASS) + ">>"
SNAPSHOT_OBJECTS = {"structured_data": "variant", "image_candidates": _fields(IMAGE), "facts": _fields(FACT), "ocr_text_blocks": _fields(BLOCK), "ocr_image_results": IMAGE_RESULT}
SNAPSHOT = ", ".join(["raw_url string, canonical_url string, page_class string, product_name string, language_scores map<string, double>", *[f"{c} string" for c in SNAPSHOT_TEXTS], *[f"{c} array<string>" for c in SNAPSHOT_LISTS], *[f"{c} {k}" for c, k in SNAPSHOT_NUMBERS.items()], *[f"{c} boolean" for c in SNAPSHOT_FLAGS], *[f"{c} array<{k}>" for c, k in SNAPSHOT_OBJECTS.items()]])


def snapshot_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Snapshots from JSON texts: either url stands in for the other, absent lists are empty, absent flags false, blank texts null, and a fact names the product where no field does."""
    own = payloads.select(F.from_json(column, SNAPSHOT).alias("s")).select("s.*")
    named = F.get(F.filter(F.coalesce("facts", F.array().cast(f"array<{SNAPSHOT_OBJECTS['facts']}>")), lambda f: f["type"] == "product_name"), F.lit(0))
    fact_name = F.nullif(F.trim(F.coalesce(F.nullif(named["normalized_value"], F.lit("")), named["value"], F.lit(""))), F.lit(""))
    url, canonical = (F.nullif(c, F.lit("")) for c in ("raw_url", "canonical_url"))
    kinds = {c: own.schema[c].dataType for c in (*SNAPSHOT_LISTS, *SNAPSHOT_OBJECTS)}
    return own.select(
        F.coalesce(url, canonical, F.lit("")).alias("raw_url"),
        F.coalesce(canonical, url, F.lit("")).alias("canonical_url"),
        F.coalesce("page_class", F.lit("")).alias("page_class_hint"),
        F.coalesce(F.nullif("product_name", F.lit("")), fact_name).alias("product_name"),
        F.coalesce("language_scores", F.create_map().cast("map<string, double>")).alias("language_scores"),
        *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in SNAPSHOT_TEXTS],
        *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in kinds.items()],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in SNAPSHOT_FLAGS],
        *SNAPSHOT_NUMBERS,
    )


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of JSON files, one a file."""
    return snapshot_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))
