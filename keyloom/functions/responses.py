"""Model answers as rows: fenced or wrapped JSON, the object wanted found at any depth, and deduplication answers joined back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from keyloom.functions.tables import spread
from keyloom.functions.web import intent_id
from keyloom.operators.slots import default_slot
from keyloom.workers import ready

#: Lists of an answer in the order in which one is taken, and the keys of a deduplication answer.
NAMES = ("intents", "items", "keywords", "rows")
DEDUP = ("surviving", "dropped_duplicates", "dropped_low_quality", "slot_gap_report", "gap_report")
FIELDS = ("intent_id", "category", "keyword", "slot_type", "reason", "evidence_tier", "quality_score", "quality_reason")
PLATFORMS = ("naver_sa", "google_sa")
#: ``platforms`` is null where the answer leaves them open; the labels stand in rows of the older form alone.
ITEM = StructType([*[StructField(f, StringType()) for f in FIELDS], StructField("keep", BooleanType()), StructField("platforms", ArrayType(StringType())), StructField("naver_match", StringType()), StructField("google_match", StringType())])
DROPPED = StructType([StructField(f, StringType()) for f in ("intent_text", "duplicate_of", "quality_score", "reason")])
REPORT = StructType([StructField("surviving", ArrayType(ITEM)), StructField("dropped_duplicates", ArrayType(DROPPED)), StructField("dropped_low_quality", ArrayType(DROPPED)), StructField("gaps", ArrayType(StructType([StructField("slot", StringType()), StructField("missing", LongType())])))])
_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*|\s*```\s*$")


def outer_json(text: str | None) -> object:
    """The JSON value of a response: fences stripped, else from the first to the last brace or bracket; None if there is none."""
    body = _FENCE.sub("", text or "").strip()
    opens = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    end = max(body.rfind("}"), body.rfind("]"))
    for t in (body, body[min(opens) : end + 1] if opens and min(opens) < end else ""):
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def container(value: object, wanted: Iterable[str]) -> dict | None:
    """The first object, in the order of the text, that has one of the wanted keys; texts that hold JSON are looked into."""
    wanted, pending = set(wanted), [value]
    while pending:
        now = pending.pop()
        if isinstance(now, dict):
            if wanted & now.keys():
                return now
            pending.extend(reversed(list(now.values())))
        elif isinstance(now, list):
            pending.extend(reversed(now))
        elif isinstance(now, str) and now.lstrip()[:1] in ("{", "[", "`"):
            pending.append(outer_json(now))
    return None


def _text(value: object) -> str | None:
    return None if value is None else str(value).strip() or None


def _item(x: dict, kind: str) -> dict | None:
    out = {f: _text(x.get(f)) for f in FIELDS}
    out["keyword"] = _text(x.get("keyword")) or _text(x.get("intent_text"))
    out["quality_reason"] = out["quality_reason"] or out["reason"]
    scope = str(x.get("platform_scope") or "").strip().lower()
    stated = x.get("allowed_platforms") if isinstance(x.get("allowed_platforms"), list) else []
    platforms = list(PLATFORMS) if scope in ("all", "both") else [scope] if scope in PLATFORMS else [p for p in stated if p in PLATFORMS] or None
    labels = {f: _text(x.get(f)) if kind == "rows" else None for f in ("naver_match", "google_match")}
    if kind == "rows":
        platforms = [p for p, label in zip(PLATFORMS, labels.values(), strict=True) if label and out["keyword"]]
    if kind in ("items", "keywords"):
        if not out["category"]:
            return None
        out["intent_id"] = None  # made from category and keyword
    return out | {"keep": bool(x.get("keep", True)), "platforms": platforms} | labels


def find_items(value: object, names: tuple[str, ...] = NAMES) -> list[dict]:
    """Items of an answer: the first list, by the order of names, of the first object that has one of them; a bare list of objects counts as one."""
    held = container(value, names)
    if held is None:
        kind, items = "items", value if isinstance(value, list) else []
    else:
        kind, items = next(((n, held[n]) for n in names if isinstance(held.get(n), list)), ("", []))
    made = (_item(x, kind) for x in items if isinstance(x, dict))
    return [x for x in made if x is not None]


@F.pandas_udf(ArrayType(ITEM))
def response_items(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: find_items(outer_json(t)))


@F.pandas_udf(REPORT)
def response_report(texts: pd.Series) -> pd.DataFrame:
    def one(t: str | None) -> dict:
        held = container(outer_json(t), DEDUP) or {}
        listed = lambda n: [x for x in held.get(n) or [] if isinstance(x, dict)] if isinstance(held.get(n), list) else []
        dropped = lambda n: [{f.name: _text(x.get(f.name)) for f in DROPPED} for x in listed(n)]
        gaps = next((held[n] for n in DEDUP[3:] if isinstance(held.get(n), dict)), {})
        return {"surviving": [_item(x, "surviving") for x in listed("surviving")], "dropped_duplicates": dropped("dropped_duplicates"), "dropped_low_quality": dropped("dropped_low_quality"), "gaps": [{"slot": k, "missing": int(v)} for k, v in gaps.items() if isinstance(v, (int, float))]}

    return pd.DataFrame([one(t) for t in texts], columns=REPORT.names)


def parsed_rows(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """Items of responses in order; those without a keyword go, a missing id is made from category and keyword, a missing slot from the category."""
    out = ready(answers).select("*", F.posexplode(response_items(text_col)).alias("ord", "item"))
    out = out.select(*[c for c in answers.columns if c != text_col], "ord", "item.*").where(F.col("keyword").isNotNull())
    return out.withColumns({"intent_id": F.coalesce("intent_id", intent_id(F.coalesce("category", F.lit("")), F.col("keyword"))), "slot_type": F.coalesce("slot_type", default_slot(F.col("category")))})


def reports(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """Deduplication answers, taken apart: columns of REPORT beside those of ``answers``."""
    return ready(answers).withColumn("report_", response_report(text_col)).select(*[c for c in answers.columns if c != text_col], "report_.*")


def answered_rows(reports_: DataFrame, by: list[str]) -> DataFrame:
    """What deduplication answers let survive, in order: ``by``, place, and the fields of an item. Refused ones go."""
    return reports_.select(*by, F.posexplode("surviving").alias("place", "x")).select(*by, "place", "x.*").where("keep")


def grams(text: Column, size: int = 3) -> Column:
    """All substrings of up to ``size`` characters, the empty one included."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), F.lit(size)), lambda n: F.substring(text, i, n)))))


def contained(short: DataFrame, long: DataFrame, by: list[str], size: int = 3) -> DataFrame:
    """Pairs of rows with equal ``by`` of which the text ``s`` is within the text ``t``: drawn by the first characters of ``s`` from an index of the substrings of ``t``, then tested."""
    probe = short.withColumn("gram_", F.substring("s", 1, size))
    index = long.withColumn("gram_", F.explode(grams(F.col("t"), size)))
    return probe.join(spread(index), [*by, "gram_"]).where(F.contains("t", F.col("s"))).drop("gram_")


def surviving(candidates: DataFrame, answered: DataFrame, by: list[str]) -> DataFrame:
    """Candidates (``by``, intent_id, ord, category, keyword) that an answer (``by``, place, intent_id, category, keyword, quality_score, quality_reason) of their own product names.

    An answer names a candidate by its id; else by the id that its category and keyword make; else it is the
    first candidate, by ``ord``, whose keyword holds the answer's or is held by it. A candidate stays once, with the last judgement on it.
    """
    own = candidates.withColumn("id_", F.coalesce(F.nullif("intent_id", F.lit("")), intent_id(F.coalesce("category", F.lit("")), F.coalesce("keyword", F.lit("")))))
    # of candidates with one id the last counts, in the place of the first
    one = own.groupBy(*by, "id_").agg(F.min("ord").alias("first_"), F.max_by(F.struct(*candidates.columns), "ord").alias("row_"))
    asked = answered.select(*by, "place", "quality_score", "quality_reason", F.coalesce("intent_id", F.lit("")).alias("said_id"), F.coalesce("keyword", F.lit("")).alias("said"), F.coalesce("category", F.lit("")).alias("said_category"))
    made = F.when(F.col("said") != "", intent_id(F.col("said_category"), F.col("said")))
    names = F.explode(F.array_compact(F.array(F.when(F.col("said_id") != "", F.struct(F.lit(0).alias("way"), F.col("said_id").alias("id_"))), F.when(made.isNotNull(), F.struct(F.lit(1).alias("way"), made.alias("id_"))))))
    key = [*by, "place"]
    by_id = asked.select("*", names.alias("n")).select(*key, "n.way", "n.id_").join(spread(one.select(*by, "id_", "first_")), [*by, "id_"])
    rest = asked.where("said <> ''").join(spread(by_id.select(*key).distinct()), key, "left_anti")
    texts = one.select(*by, "id_", "first_", F.coalesce("row_.keyword", F.lit("")).alias("kw"))
    within = contained(rest.select(*key, F.col("said").alias("s")), texts.withColumnRenamed("kw", "t"), by)
    around = contained(texts.withColumnRenamed("kw", "s"), rest.select(*key, F.col("said").alias("t")), by)
    by_text = within.select(*key, F.lit(2).alias("way"), "id_", "first_").unionByName(around.select(*key, F.lit(2).alias("way"), "id_", "first_"))
    best = by_id.select(*key, "way", "id_", "first_").unionByName(by_text).groupBy(*key).agg(F.min(F.struct("way", "first_", "id_"))["id_"].alias("id_"))
    judged = best.join(spread(asked.select(*key, "quality_score", "quality_reason")), key).groupBy(*by, "id_").agg(F.max_by(F.struct("quality_score", "quality_reason"), "place").alias("j_"))
    rest_cols = [c for c in candidates.columns if c not in ("quality_score", "quality_reason")]
    return one.join(spread(judged), [*by, "id_"]).select(*[F.col(f"row_.{c}").alias(c) for c in rest_cols], "j_.quality_score", "j_.quality_reason")


def pairs_of_duplicates(reports_: DataFrame, by: list[str]) -> DataFrame:
    """Candidates an answer calls duplicates, and of what, in order."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    out = reports_.select(*by, F.posexplode("dropped_duplicates").alias("place", "x")).select(*by, "place", "x.intent_text", "x.duplicate_of", "x.reason")
    return out.where(F.col("intent_text").isNotNull()).withColumn("place", turn)
