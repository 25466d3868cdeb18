"""Intents to keyword rows, and the deterministic generation from packs to validated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import keywords as K
from keyloom.functions.arrays import none, rows_of, texts, unique, where_here
from keyloom.functions.tables import spread
from keyloom.operators import bank, interpret, rows, surface
from keyloom.scratch import written

MODES = {"naver_sa": ("naver_sa",), "google_sa": ("google_sa",), "both": ("naver_sa", "google_sa")}
#: Fields of an intent beside its own: who may show it, and how.
RENDERS = "allowed_platforms array<string>, shared struct<keyword:string,admitted:boolean>, naver struct<keyword:string,match_label:string,admitted:boolean>, google struct<keyword:string,match_label:string,admitted:boolean>"


def default_reason(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in dims.DEFAULT_REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit(dims.OTHER_REASON))


def allowed_platforms(mode: str) -> Column:
    """Platforms of an intent: stated ones, else those it has renders for, else all wanted ones if it has a shared render."""
    stated = F.filter(F.coalesce("allowed_platforms", none()), lambda p: p.isin("naver_sa", "google_sa"))
    own = F.array_compact(F.array(F.when(F.col("naver").isNotNull(), "naver_sa"), F.when(F.col("google").isNotNull(), "google_sa")))
    return F.when(F.size(stated) > 0, stated).when(F.size(own) > 0, own).when(F.col("shared").isNotNull(), texts(MODES[mode])).otherwise(none())


def rendered(intents: DataFrame, mode: str = "both") -> DataFrame:
    """Rows of intents (url, ord, category, reason, slot_type, evidence_tier, quality_score and RENDERS): one row with both labels where the keywords agree, else one for each platform.

    A shared render stands in for a platform's missing one, with the default label of the category.
    """
    out = intents.withColumn("on", allowed_platforms(mode))
    shared = F.coalesce(F.col("shared.admitted"), F.lit(False))

    def side(name: str, platform: str, label: Column) -> Column:
        own = F.col(name)
        fill = shared & F.array_contains("on", platform) & F.lit(platform in MODES[mode])
        hydrated = F.when(own.isNotNull(), own).when(fill, F.struct(F.col("shared.keyword").alias("keyword"), label.alias("match_label"), F.lit(True).alias("admitted")))
        good = hydrated["admitted"] & (hydrated["keyword"] != "") & (hydrated["match_label"] != "")
        return F.when(F.coalesce(good, F.lit(False)), hydrated)

    out = out.withColumns({"n_": side("naver", "naver_sa", K.naver_label(F.col("category"))), "g_": side("google", "google_sa", K.google_label(F.col("category")))})
    empty = F.lit("")
    row = lambda k, n, g: F.struct(k.alias("keyword"), n.alias("naver_match"), g.alias("google_match"))
    n, g = F.col("n_"), F.col("g_")
    both = n["keyword"] == g["keyword"]
    made = F.when(F.coalesce(both, F.lit(False)), F.array(row(n["keyword"], n["match_label"], g["match_label"]))).otherwise(
        F.array_compact(F.array(F.when(n.isNotNull(), row(n["keyword"], n["match_label"], empty)), F.when(g.isNotNull(), row(g["keyword"], empty, g["match_label"]))))
    )
    reason = F.coalesce(F.nullif("reason", F.lit("")), default_reason(F.col("category")))
    rest = [c for c in intents.columns if c not in ("allowed_platforms", "shared", "naver", "google", "reason", "keyword")]
    return rows_of(out.withColumn("reason", reason), made, *rest, "reason", item="row", place="part").select(*rest, "part", "reason", "row.*")


def with_renders(intents: DataFrame, mode: str = "both") -> DataFrame:
    """Intents with a keyword, shown on every wanted platform."""
    key = F.col("keyword")
    on = lambda platform, label: F.when(F.lit(platform in MODES[mode]), F.struct(key.alias("keyword"), label.alias("match_label"), F.lit(True).alias("admitted")))
    return intents.withColumns(
        {
            "allowed_platforms": texts(MODES[mode]),
            "shared": F.struct(key.alias("keyword"), F.lit(True).alias("admitted")),
            "naver": on("naver_sa", K.naver_label(F.col("category"))),
            "google": on("google_sa", K.google_label(F.col("category"))),
        }
    )


def identity(interpreted_url: Column, name: Column, short: Column, brand: Column) -> Column:
    """What names the product itself: name, short name, brand, their words, and words of the url's path."""
    path = F.regexp_extract(interpreted_url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    words = F.concat(K.tokens(name), K.tokens(short), F.split(path, "[^A-Za-z0-9가-힣]+"))
    return unique(F.concat(F.array(name, short, F.coalesce(brand, F.lit(""))), F.filter(words, lambda w: F.length(w) >= 2)))


CONTEXT = ("name", "brand", "short", "page_class", "types", "competitors", "category_terms", "product_category", "secondary", "audience", "concerns", "usage", "events", "measures", "specs", "ingredients", "technology", "form_factors", "quality_warning")


def in_context(rows_: DataFrame, banked: DataFrame) -> DataFrame:
    """Rows with what the policy and surface rules read of their product; one join on url, by which the rows lie together from then on."""
    own = banked.select("url", *[c for c in CONTEXT if c in banked.columns], F.col("name").alias("product_name"), identity(F.col("url"), F.col("name"), F.col("short"), F.col("brand")).alias("identity"))
    return rows_.drop("product_name", "brand").join(spread(own), "url")


def generate(packs: DataFrame, mode: str = "both", most: int = 100, verbose: bool = False, ask: Callable[[int, DataFrame, DataFrame], DataFrame] | None = None, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Keyword rows of evidence packs, and one report per product: interpret, build the bank, plan, pick, render, filter, supplement, score, select, validate.

    Thin pages (``sufficiency`` borderline) aim for four rows fewer. Products that fail still give their rows. The banks are
    read several times, so they are a table (``scratch.written``); so are the rows that pass the rules, which are scored, picked and counted.

    ``ask`` is a model that is asked in at most ``rounds`` rounds for what the rows lack (see ``supplement.supplemented``): it gives intents
    (url, category, slot_type, keyword, reason, evidence_tier). The report then has ``rounds``, ``missing``, ``added`` and ``reason`` too.
    """
    from keyloom.operators import supplement

    if mode not in MODES:
        raise ValueError(f"unsupported platform mode: {mode}")
    banked = written(bank.with_bank(interpret.interpreted(packs), verbose))
    borderline = (F.col("sufficiency") == "borderline") if "sufficiency" in banked.columns else F.lit(False)
    plan = bank.category_plan(banked, F.when(borderline, F.lit(max(0, min(most, 100) - 4))).otherwise(F.lit(most)))

    def shown(intents_: DataFrame) -> DataFrame:
        return rendered(with_renders(intents_, mode), mode).withColumn("quality_score", F.lit(None).cast("string"))

    def clean(made: DataFrame) -> DataFrame:
        judged = where_here(rows.with_issues(in_context(made, banked)), F.size("hard_issues") == 0)
        return where_here(surface.with_surface(judged, verbose), ~F.col("surface_hard"))

    judged, lacking = clean(shown(bank.intents(banked, plan, verbose))), None
    if ask is not None:
        slot = bank.slot_plan(banked, plan)
        turn = F.row_number().over(Window.partitionBy("url").orderBy("category", F.desc("required"), "slot_type"))
        own = [c for c in ("url", "ord", "intent_id", "category", "slot_type", "evidence_tier", "part", "reason", "keyword", "naver_match", "google_match", "quality_score") if c in judged.columns]

        def asked(number: int, wanted: DataFrame, have: DataFrame) -> DataFrame:
            place = F.row_number().over(Window.partitionBy("url").orderBy("category", "slot_type", "keyword"))
            new = ask(number, wanted, have).where(F.col("category").isin(*dims.CATEGORY_TARGETS, dims.NEGATIVE))
            new = new.select("url", (place + 1_000_000 * number).alias("ord"), F.concat_ws(":", "category", "keyword").alias("intent_id"), "category", "slot_type", "keyword", "reason", "evidence_tier")
            return shown(new)

        more, lacking = supplement.supplemented(banked, judged.select(*own), slot.withColumn("place", turn), asked, clean, most, mode, rounds)
        judged = clean(more)
    names = ["url", "ord", "product_name", "category", "keyword", "slot_type", "naver_match", "google_match", "reason", "quality_warning", "evidence_tier", "quality_score", "issues", "hard_issues"]
    if "quality_warning" not in judged.columns:
        judged = judged.withColumn("quality_warning", F.lit(False))
    judged = written(judged.select(*names, "surface"))
    positive = rows.select_rows(rows.selection_scores(judged), most, mode)
    chosen = positive.select(*names, "score", "penalties", "place").unionByName(judged.where(F.col("category") == dims.NEGATIVE).select(*names), allowMissingColumns=True)
    report = rows.validation_report(rows.validation(chosen))
    short_of = F.coalesce((F.col("status") == "COMPLETED") & (F.col("least_positives") < most), F.lit(False))
    report = report.withColumns(
        {
            "failure_code": F.when(short_of, "generation_count_shortfall").otherwise(F.col("failure_code")),
            "failure_detail": F.when(short_of, f"unable to reach target {most} without fallback top-up").otherwise(F.col("failure_detail")),
            "status": F.when(short_of, "FAILED_GENERATION").otherwise(F.col("status")),
        }
    )
    return chosen, report if lacking is None else report.join(spread(lacking), "url", "left")


def restored_heads(rows_: DataFrame, sources: DataFrame, banked: DataFrame, most: int = 2) -> DataFrame:
    """Rows with generic heads put back that a filter lost though a longer wording of them stayed (see ``surface.missing_heads``).

    ``sources``: the intents' rows before filtering (url, ord, category, keyword and the fields of ``rows_``).
    """
    generic = lambda d, name: d.where(F.col("category") == "generic_category").groupBy("url").agg(F.collect_list("keyword").alias(name))
    # admission comes first: a head that the rules refuse neither counts against the limit nor as a row for later ones
    found = sources.where(F.col("category") == "generic_category").withColumn("head_", F.lower(F.trim(F.regexp_replace("keyword", r"\s+", " "))))
    first = found.groupBy("url", "head_").agg(F.min_by(F.struct(*sources.columns), "ord").alias("row"))
    judged = surface.with_surface(rows.with_issues(in_context(rows.hard_rules(first.select("row.*")), banked)))
    judged = where_here(judged, ~F.col("surface_hard") & (F.size("hard_issues") == 0)).select(*[c for c in rows_.columns if c in judged.columns])
    one = banked.select("url", "name", "brand", "short", "category_terms").join(spread(generic(rows_, "generic")), "url").join(spread(generic(judged, "sources")), "url")
    put = surface.missing_heads(one, most).select("url", F.lower("keyword").alias("head_"))
    again = judged.withColumn("head_", F.lower(F.trim(F.regexp_replace("keyword", r"\s+", " ")))).join(spread(put), ["url", "head_"], "left_semi").drop("head_")
    return rows_.unionByName(again, allowMissingColumns=True)
