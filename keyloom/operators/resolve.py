"""Pages to packs or failures: classify, render again where that is worth it, read images, gate, build evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.arrays import none, where_here
from keyloom.functions.tables import spread
from keyloom.operators import evidence, pages, recognised

FAILURE = ("page_id", "url", "page_class", "failure_code", "failure_detail", "hints")


def resolve(fetched: DataFrame, rendered: DataFrame | None = None, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Packs of pages that are supported, and failures of the others (FAILURE columns).

    ``fetched``: page_id, url, html and optionally error (a page that was not fetched has no html). ``rendered``: the same
    and cleaned_html, for pages that were fetched again; they replace those whose first fetch asks for it
    (``pages.fallback_reason``). ``blocks``: text recognised in images (see ``recognised``).
    """
    first = fetched if "error" in fetched.columns else fetched.withColumn("error", F.lit(None).cast("string"))
    got = first.where("html is not null").select("page_id", "url", "html")
    snap = pages.gated(pages.snapshot(got)).withColumn("fallback_reason", pages.fallback_reason())
    lost = first.where("html is null").select("page_id", "url", "error")
    if rendered is None:
        final, failed = snap.withColumns({"fallback_reason": F.lit(None).cast("string"), "fallback_used": F.lit(False)}), _unfetched(lost, False)
    else:
        asked, settled = where_here(snap, F.col("fallback_reason").isNotNull()), where_here(snap, F.col("fallback_reason").isNull())
        wanted = asked.select("page_id", "fallback_reason").unionByName(lost.select("page_id", F.lit("baseline_fetch_failed").alias("fallback_reason")))
        again = rendered.join(wanted, "page_id")
        second = again.where("html is not null").select("page_id", "url", "html", "cleaned_html", "fallback_reason")
        redone = pages.gated(pages.preprocessed_snapshot(second)).withColumn("fallback_used", F.lit(True)).drop("cleaned_html")
        kept = settled.unionByName(asked.join(rendered.select("page_id"), "page_id", "left_anti"))
        final = kept.withColumns({"fallback_reason": F.lit(None).cast("string"), "fallback_used": F.lit(False)}).unionByName(redone)
        error = again["error"] if "error" in again.columns else F.lit("empty html")
        missed = again.where("html is null").select("page_id", "url", error.alias("error"))
        failed = _unfetched(missed, True).unionByName(_unfetched(lost.join(rendered.select("page_id"), "page_id", "left_anti"), False))
    if blocks is not None:
        judged = recognised.judged(blocks, final.select("page_id", "product_name", "tokens", "text", "page_class")).where("rejected is null")
        admitted = judged.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("direct")).alias("d"), (-F.col("score")).alias("s"), "text"))), lambda b: b["text"]).alias("admitted"))
        direct = recognised.direct_candidates(recognised.line_groups(judged)).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda b: b["text"]).alias("direct"))
        final = final.join(spread(admitted), "page_id", "left").join(spread(direct), "page_id", "left")
        final = final.withColumns({c: F.coalesce(F.col(c), none()) for c in ("admitted", "direct")})
    after = F.when(F.col("fallback_used"), " after Crawl4AI fallback").otherwise("")
    why = F.when(F.col("fallback_used"), F.array(F.concat(F.lit("Crawl4AI fallback was triggered because `"), "fallback_reason", F.lit("`")))).otherwise(none())
    detail = F.concat("page_class", F.lit(" is unsupported for generation"), after)
    unsupported = where_here(final, ~F.col("supported")).select("page_id", "url", "page_class", "failure_code", detail.alias("failure_detail"), F.concat(pages.failure_hints(), why).alias("hints"))
    return evidence.packs(where_here(final, F.col("supported"))), unsupported.unionByName(failed)


def _unfetched(lost: DataFrame, rendered: bool) -> DataFrame:
    return lost.select("page_id", "url", F.lit(None).cast("string").alias("page_class"), F.lit("collection_fetch_failed").alias("failure_code"), F.coalesce("error", F.lit("")).alias("failure_detail"), pages.fetch_hints(F.col("error"), F.lit(rendered)).alias("hints"))
