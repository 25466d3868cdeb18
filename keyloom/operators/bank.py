"""Phrase bank of an interpreted product, its plan over categories and slots, and the pick of keywords.

An interpreted pack is one row; its bank is one array of candidates, so building and picking need no
shuffle. Candidates are structs of pos (category), ord, category, keyword, reason, tier and slot_type.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import keywords as K
from keyloom.functions.arrays import collapse, first_of_each, let, none, rows_of, texts, unique, words_of
from keyloom.functions.tables import spread
from keyloom.operators import interpret, quota, slots, surface
from keyloom.workers import ready

POSITIVES = tuple(dims.CATEGORY_TARGETS)
BUDGET_OF_WEAK, NEGATIVES = 20, 10
CANDIDATE = "struct<pos:int,category:string,keyword:string,reason:string,tier:string,slot_type:string>"


def signature(keyword: Column) -> Column:
    """Words without those that name a store, shallow last words cut, repeats in a row once."""
    return _signature(words_of(F.lower(F.replace(keyword, F.lit("|"), F.lit(" ")))))


def _signature(words: Column) -> Column:
    kept = F.filter(words, lambda w: ~w.isin(*dims.STORE_TOKENS))
    once = lambda t: F.transform(F.filter(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(t, x["i"] - 1) != x["w"])), lambda x: x["w"])
    return let(kept, lambda t: let(K.strip_tail(t, dims.SHALLOW_TOKENS), lambda s: F.array_join(once(s), " ")))


def signed(keywords: Column) -> Column:
    """Keywords ``k``, white space collapsed already, with their signatures ``s``."""
    words = lambda k: F.filter(F.split(F.replace(F.lower(k), F.lit("|"), F.lit(" ")), " "), lambda w: w != "")
    return F.transform(keywords, lambda k: F.struct(k.alias("k"), _signature(words(k)).alias("s")))


#: Parts that many phrases share: columns of their own, so that a row computes them once.
SHARED = ("alias", "kind_head", "own_name", "maker")


def _shared(out: DataFrame) -> DataFrame:
    """``alias``: the name's first word where it is not the brand; ``kind_head``: the last word of the category; ``own_name``: the short name without the alias; ``maker``: alias or brand."""
    out = out.withColumn("alias", _brand_alias()).withColumn("kind_head", interpret.head(F.col("product_category")))
    alias, name = F.col("alias"), F.col("name")
    own = F.when((F.col("short") == name) & alias.isNotNull() & name.startswith(F.concat(alias, F.lit(" "))), F.trim(F.substring(name, F.length(alias) + 1, F.length(name)))).otherwise(F.col("short"))
    return out.withColumns({"own_name": own, "maker": F.coalesce(alias, F.nullif("brand", F.lit("")))})


def _join(*parts: Column) -> Column:
    return F.concat(*[p for x in parts for p in (F.lit(" "), x)][1:])


def _each(values: Column, *forms) -> Column:
    """Every form of every value, value by value."""
    return F.flatten(F.transform(values, lambda v: F.array(*[f(v) for f in forms])))


def _if(condition: Column, values: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), values).otherwise(none())


def _attributes(name: Column) -> Column:
    return F.transform(F.slice("measures", 1, 6), lambda m: _join(name, m))


def _comparisons() -> Column:
    options = F.filter(F.concat(F.array("product_category"), F.col("secondary")), lambda c: ~c.isin(*dims.COMPETITOR_BLOCKED))
    kind = F.coalesce(F.get(options, F.lit(0)), F.col("product_category"))
    return _each(F.slice("competitors", 1, 4), lambda b: _join(b, kind), lambda b: _join(b, kind, F.lit("비교")))


def _brand_alias() -> Column:
    """The name's first word where it is not the brand; null if it is."""
    first = F.get(words_of(F.col("name")), F.lit(0))
    return let(first, lambda w: F.when((w != "") & (F.lower(w) != F.lower(F.coalesce("brand", F.lit("")))), w))


def _purchases(verbose: bool) -> Column:
    name, kind, brand, own = (F.col(c) for c in ("name", "product_category", "maker", "own_name"))
    differs = (own != "") & (own != name)
    out = F.concat(F.array(name), _if(differs, F.array(own)), _if(brand.isNotNull(), F.array(_join(brand, F.col("kind_head")), _join(brand, kind))), _if(brand.isNotNull() & differs, F.array(_join(brand, own))))
    return F.concat(out, F.array(_join(name, F.lit("공식몰"))), _if(brand.isNotNull(), F.array(_join(brand, F.lit("공식몰"))))) if verbose else out


def _long_tails(name: Column) -> Column:
    kind = F.col("product_category")
    return F.concat(_each(F.slice("ingredients", 1, 4), lambda a: _join(a, kind), lambda a: _join(a, F.col("kind_head"))), _each(F.slice("specs", 1, 2), lambda s: _join(name, s), lambda s: _join(kind, s)))


def _prices(name: Column, verbose: bool) -> Column:
    kind = F.col("product_category")
    out = F.concat(_if(F.coalesce("price", F.lit("")) != "", F.array(_join(name, F.lit("가격")), _join(kind, F.lit("가격")))), _if(F.col("price_compared"), F.array(_join(name, F.lit("가격 비교")))) if verbose else none())
    return F.concat(out, _each(F.slice("value_terms", 1, 4), lambda t: _join(name, t), lambda t: _join(kind, t)))


def _seasons() -> Column:
    kind = F.col("product_category")
    return _each(F.col("events"), lambda e: _join(e, F.col("kind_head")), lambda e: _join(e, kind))


def _problems() -> Column:
    kind = F.col("product_category")
    return _each(F.transform(F.slice("concerns", 1, 6), collapse), lambda c: _join(c, F.col("kind_head")), lambda c: F.when(F.col("kind_head") != kind, _join(c, kind)))


def _bank(verbose: bool) -> dict[str, tuple[Column, Column, Column, str, Column]]:
    """By category: phrases, their reason, tier and slot, and phrases to pad with."""
    name, brand, short, kind = (F.col(c) for c in ("name", "brand", "short", "product_category"))
    branded = F.coalesce(brand, F.lit("")) != ""
    feature = F.when(interpret.is_support(F.col("page_class")), short).otherwise(name)
    secondary = F.slice("secondary", 1, 3)
    alias = F.col("alias")
    own = F.concat(F.array(brand, _join(brand, kind)), F.transform(secondary, lambda t: _join(brand, t)), F.array(_join(alias, kind)), F.transform(secondary, lambda t: _join(alias, t)))
    lit = F.lit
    said = lambda start, end: F.concat(start, lit(end))
    lead = F.when(branded, brand).otherwise(name)
    valued = (F.coalesce("price", lit("")) != "") | (F.size("value_terms") > 0)
    generic = F.concat(F.array(kind), F.col("secondary"), _if(branded, F.array(_join(brand, kind))), _if((short != kind) & (short != name), F.array(_join(short, kind))))
    plain = F.coalesce(brand, lit(""))
    return {
        "brand": (F.when(branded, own).otherwise(F.array(name, short)), said(lead, " 제품명 직접 증거 기반"), lit("direct"), "product_name", F.concat(F.array(_join(plain, kind)), F.transform(F.slice(F.concat(F.array(kind), F.col("secondary")), 1, 3), lambda t: _join(plain, t)))),
        "generic_category": (generic, said(kind, " 카테고리 근거 기반"), lit("inferred"), "generic_type_phrase", F.concat(F.array(_join(plain, kind)), _if(short != kind, F.array(_join(short, kind))))),
        "feature_attribute": (_attributes(feature), said(feature, " 속성 및 스펙 기반"), lit("direct"), "spec", _attributes(short)),
        "competitor_comparison": (_comparisons(), said(kind, " 동일 제품군 경쟁 브랜드 탐색"), lit("weak"), "competitor_brand_type", _comparisons()),
        "purchase_intent": (_purchases(verbose), said(name, " 제품명 및 브랜드 탐색 의도"), lit("derived"), "navigational_alias", _purchases(verbose)),
        "long_tail": (_long_tails(feature), said(feature, " 조합 확장"), lit("derived"), "use_case_phrase", _long_tails(short)),
        "benefit_price": (_prices(feature, verbose), said(feature, " 직접 근거 기반 효익 및 가격 탐색"), F.when(valued, "direct").otherwise("derived"), "product_price", _prices(short, verbose)),
        "season_event": (_seasons(), said(feature, " 시즌 및 상황 탐색"), lit("inferred"), "seasonal_context", _seasons()),
        "problem_solution": (_problems(), said(feature, " 문제 해결 및 효익 탐색"), F.when(F.coalesce("weak_backfill_used", lit(False)), "weak").otherwise("inferred"), "problem_noun_phrase", _problems()),
    }


def with_bank(interpreted: DataFrame, verbose: bool = False) -> DataFrame:
    """Interpreted packs with ``bank``: the candidates of all categories in order, padded, each signature once a category; and their ``signatures``.

    Padding stops at max(target + 8, 24) candidates. With ``weak_backfill_used``, the first 20 problem phrases are weak.
    """
    out = interpreted.withColumnRenamed("category", "product_category")
    if "weak_backfill_used" not in out.columns:
        out = out.withColumn("weak_backfill_used", F.lit(False))
    out = _shared(out)
    parts = _bank(verbose)
    # what is verbatim among the own phrases has a signature of theirs, so it never pads
    out = out.withColumns({f"raw_{c}": p[0] for c, p in parts.items()})
    out = out.withColumns({f"own_{c}": signed(unique(F.col(f"raw_{c}"))) for c in parts} | {f"pad_{c}": signed(F.filter(unique(F.array_except(p[4], F.col(f"raw_{c}"))), lambda k: ~K.low_information(k))) for c, p in parts.items()})

    def candidates(pos: int, category: str) -> Column:
        _, reason, tier, slot, _ = parts[category]
        entry = lambda e, r, t, s: F.struct(e["s"].alias("s"), F.struct(F.lit(pos).alias("pos"), F.lit(category).alias("category"), e["k"].alias("keyword"), r.alias("reason"), t.alias("tier"), s.alias("slot_type")).alias("c"))
        weak = lambda e, i: F.when(F.col("weak_backfill_used"), e.withField("c.tier", F.when(i < BUDGET_OF_WEAK, "weak").otherwise("inferred"))).otherwise(e)

        def built(own: Column) -> Column:
            room = F.greatest(F.lit(max(dims.CATEGORY_TARGETS[category] + 8, 24)) - F.size(own), F.lit(0))
            spare = let(own["s"], lambda taken: first_of_each(F.filter(F.col(f"pad_{category}"), lambda e: ~F.array_contains(taken, e["s"])), lambda e: e["s"]))
            first = F.transform(own, lambda e: entry(e, reason, tier, F.lit(slot)))
            more = F.transform(F.slice(spare, F.lit(1), room), lambda e: entry(e, F.concat(F.col("name"), F.lit(f" {category} supplementation pool")), F.lit("inferred"), F.lit(None).cast("string")))
            every = F.concat(first, more)
            return first_of_each(F.transform(every, weak) if category == "problem_solution" else every, lambda e: e["s"])

        return let(F.col(f"own_{category}"), built)

    made = {f"bank_{c}": candidates(i, c) for i, c in enumerate(parts)}
    out = out.withColumns(made).withColumns({"bank": F.concat(*[F.col(m)["c"] for m in made]), "signatures": F.concat(*[F.col(m)["s"] for m in made])}).drop(*made)
    return out.drop(*[f"{side}_{c}" for side in ("raw", "own", "pad") for c in parts], *SHARED)


def strengths() -> dict[str, Column]:
    """How much each category of an interpreted product has to go on."""
    size = lambda c: F.size(c)
    priced = F.when(F.coalesce("price", F.lit("")) != "", 0.15).otherwise(0.0)
    attributes = F.size(unique(F.concat("specs", "ingredients", "technology", "form_factors")))
    night = F.lit(False)
    for word in ("야간", "수면", "취침", "밤"):
        night = night | F.contains(F.array_join("usage", " "), F.lit(word))
    few = lambda most, value: F.least(F.lit(most), value)
    facets = size("audience") + size("benefits") + size("concerns") + size("usage")
    return {
        "brand": F.when(F.coalesce("brand", F.lit("")) != "", 1.05).otherwise(0.75),
        "generic_category": few(0.25, size("secondary") * 0.05) + 1.15,
        "feature_attribute": few(0.45, attributes * 0.06) + 1.1,
        "competitor_comparison": few(0.5, size("competitors") * 0.08) + 0.2,
        "purchase_intent": priced + 0.55,
        "long_tail": few(0.45, facets * 0.04) + 1.15,
        "benefit_price": few(0.35, size("benefits") * 0.05) + 0.85 + priced,
        "season_event": F.when(night, 0.25).otherwise(0.0) + 0.8,
        "problem_solution": few(0.35, size("concerns") * 0.07) + 0.8 + few(0.15, size("audience") * 0.03),
    }


def category_plan(banked: DataFrame, target: Column) -> DataFrame:
    """Seats (url, category, seats) of ``target`` positives: by target times strength, as many as there are candidates."""
    weights = strengths()
    count = lambda c: F.size(F.filter("bank", lambda e: e["category"] == c))
    options = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("category"), F.lit(t).alias("target"), weights[c].cast("double").alias("strength"), count(c).alias("available")) for i, (c, t) in enumerate(dims.CATEGORY_TARGETS.items())])
    demand = rows_of(banked.withColumn("total", target.cast("int")), options, "url", "total").select(F.col("url").alias("key"), "total", "x.*")
    return quota.divisor_plan(demand.withColumn("weight", F.col("target") * F.col("strength"))).withColumnRenamed("key", "url")


def picks(judged: list[dict], seats: dict[int, int], strength: list[float]) -> list[int]:
    """Places of the candidates that are picked: category by category up to the plan, then round by round; a signature is taken once.

    The order of picks decides what later ones may take, so this is a loop over one product's few hundred candidates.
    """
    size = [0] * len(POSITIVES)
    for e in judged:
        size[e["pos"]] += 1
    good = [(i, e["pos"], e["signature"]) for i, e in enumerate(judged) if not e["rejected"]]
    return _picks(good, size, seats, strength)


def _picks(good: list[tuple[int, int, str]], size: list[int], seats: dict[int, int], strength: list[float]) -> list[int]:
    """The same of the candidates that break no rule (place, category, signature); ``size``: all candidates of each category."""
    by_pos: dict[int, list[tuple[int, str]]] = {}
    for i, pos, s in good:
        by_pos.setdefault(pos, []).append((i, s))
    taken: set[str] = set()
    picked: list[list[int]] = []
    for pos in range(len(POSITIVES)):
        picked.append([])
        for i, s in by_pos.get(pos, ()):
            if s not in taken:
                picked[pos].append(i)
                taken.add(s)
                if len(picked[pos]) >= seats.get(pos, 0):
                    break
    missing = sum(seats.values()) - sum(map(len, picked))
    targets = list(dims.CATEGORY_TARGETS.values())
    order = sorted(range(len(POSITIVES)), key=lambda p: (len(picked[p]) - size[p], -strength[p], -targets[p]))
    while missing > 0:
        before = missing
        for pos in order:
            found = next(((i, s) for i, s in by_pos.get(pos, ()) if s not in taken), None)
            if found and missing > 0:
                picked[pos].append(found[0])
                taken.add(found[1])
                missing -= 1
        if missing == before:
            break
    return [i for own in picked for i in own]


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The picked candidates of each product; candidates stay Arrow columns, only what the loop reads becomes Python values."""
    for b in batches:
        bank, rejected, signatures, plan = (b.column(c) for c in ("bank", "rejected", "signatures", "plan"))
        # what a list column holds, and where each row's part of it begins
        starts, refused, signs, ends = (c.offsets.to_pylist() for c in (bank, rejected, signatures, plan))
        kinds, broken, signed_ = bank.values.field("pos").to_pylist(), rejected.values.to_pylist(), signatures.values.to_pylist()
        seats = list(zip(plan.values.field("pos").to_pylist(), plan.values.field("seats").to_pylist(), strict=True))
        strength = b.column("strength").to_pylist()
        row, place, at = [], [], []
        for n in range(b.num_rows):
            own = kinds[starts[n] : starts[n + 1]]
            size = [own.count(pos) for pos in range(len(POSITIVES))]
            good = [(i, pos, signed_[signs[n] + i]) for i, pos in enumerate(own) if not broken[refused[n] + i]]
            found = _picks(good, size, dict(seats[ends[n] : ends[n + 1]]), strength[n])
            row += [n] * len(found)
            place += range(len(found))
            at += [starts[n] + i for i in found]
        entries = bank.values.take(pa.array(at, pa.int64()))
        cols = [b.column("url").take(pa.array(row, pa.int64())), pa.array(place, pa.int32()), *(entries.field(n) for n, _ in PICKED[2:])]
        yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in PICKED])


#: Columns of picked candidates.
PICKED = (("url", "string"), ("ord", "int"), ("category", "string"), ("keyword", "string"), ("reason", "string"), ("tier", "string"), ("slot_type", "string"))


def selected(banked: DataFrame, plan: DataFrame, verbose: bool = False) -> DataFrame:
    """Candidates that are picked for a plan (url, category, seats), with their order: rows of url, ord and the candidate's fields.

    Candidates that break any surface rule are passed over. Plan and bank meet by one join on url.
    """
    pos = F.create_map(*[x for i, c in enumerate(POSITIVES) for x in (F.lit(c), F.lit(i))])
    seats = plan.groupBy("url").agg(F.sort_array(F.collect_list(F.struct(pos[F.col("category")].alias("pos"), F.col("seats").cast("int").alias("seats")))).alias("plan"))
    it = {n: F.col(n) for n in ("name", "product_category", "secondary", "audience", "concerns", "usage", "page_class", "events", "measures", "specs", "ingredients", "technology", "form_factors")}
    weights = strengths()
    # lower case and what follows the name are read by many rules, so a candidate makes them once
    broken = lambda e, bare: let(F.struct(F.lower(e["keyword"]).alias("low"), surface.suffix_of(e["keyword"], it["name"]).alias("suffix")), lambda x: surface.surface_code(e["keyword"], e["category"], it | {"bare": bare, "low": x["low"], "suffix": x["suffix"]}, verbose).isNotNull())
    out = banked if "signatures" in banked.columns else banked.withColumn("signatures", F.transform("bank", lambda e: signature(e["keyword"])))
    out = out.withColumn("rejected", let(surface.bare_suffixes(it), lambda bare: F.transform("bank", lambda e: broken(e, bare))))
    out = out.select("url", "bank", "rejected", "signatures", F.array(*[weights[c].cast("double") for c in POSITIVES]).alias("strength"))
    out = ready(out).join(spread(seats), "url", "left").withColumn("plan", F.coalesce("plan", F.array().cast("array<struct<pos:int,seats:int>>")))
    return out.mapInArrow(_picked, ", ".join(map(" ".join, PICKED)))


def negatives(interpreted: DataFrame) -> DataFrame:
    """At most ten negative terms of each product: those of the taxonomy, else the seeds, the first four after the product's name."""
    seeds = F.array(*[F.concat(F.col("name"), F.lit(" " + s)) if i < 4 else F.lit(s) for i, s in enumerate(dims.NEGATIVE_SEEDS)])
    own = let(interpret.terms_for(F.col("types"), "negative_seed"), lambda t: F.when(F.size(t) > 0, t).otherwise(seeds))
    reason = F.concat(F.col("name"), F.lit("에 무관한 전환 의도가 낮은 제외 키워드"))
    out = rows_of(interpreted.withColumn("reason", reason), F.slice(own, 1, NEGATIVES), "url", "reason", item="keyword", place="ord")
    return out.select("url", "ord", F.lit(dims.NEGATIVE).alias("category"), "keyword", "reason", F.lit("inferred").alias("tier"), F.lit("negative_exclusion").alias("slot_type"))


def intents(banked: DataFrame, plan: DataFrame, verbose: bool = False) -> DataFrame:
    """Picked candidates, then negatives, as intents: url, ord, intent_id, category, slot_type, keyword, reason, evidence_tier."""
    slot = slots.slot_type(F.col("aliases"), F.col("brand"), F.col("type_phrases"), F.concat("ingredients", "technology", "form_factors"), F.col("audience"), F.col("events"), F.col("name"))
    positive = selected(banked, plan, verbose).join(spread(banked.select("url", "aliases", "brand", "type_phrases", "ingredients", "technology", "form_factors", "audience", "events", "name")), "url")
    positive = positive.withColumn("slot_type", F.coalesce("slot_type", slot)).select("url", "ord", "category", "keyword", "reason", "tier", "slot_type")
    every = positive.unionByName(negatives(banked).withColumn("ord", F.col("ord") + 100_000))
    return every.select("url", "ord", F.concat_ws(":", "category", "keyword").alias("intent_id"), "category", "slot_type", "keyword", "reason", F.col("tier").alias("evidence_tier"))


# -- slots and batches


def slot_plan(interpreted: DataFrame, plan: DataFrame) -> DataFrame:
    """Slots of each product (url, category, slot_type, target, required, seeds): a category's seats over its slots that have seeds; negatives get one."""
    brand = F.coalesce("brand", F.lit(""))
    with_type = _if(brand != "", F.transform(F.slice("type_phrases", 1, 3), lambda t: _join(brand, t)))
    cross = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: _join(x, y))))
    two = F.slice("type_phrases", 1, 2)
    sources = [
        ("brand", "product_name", unique(F.concat(F.array("name"), F.slice("aliases", 1, 2)))),
        ("brand", "brand_with_type", unique(with_type)),
        ("brand", "navigational_alias", F.slice("aliases", 1, 4)),
        ("generic_category", "generic_type_phrase", F.slice("type_phrases", 1, 6)),
        ("feature_attribute", "spec", F.slice("specs", 1, 6)),
        ("feature_attribute", "core_attribute", unique(F.concat(F.slice("ingredients", 1, 4), F.slice("technology", 1, 4), F.slice("form_factors", 1, 4)))),
        ("purchase_intent", "navigational_alias", F.slice("aliases", 1, 6)),
        ("purchase_intent", "brand_with_type", unique(with_type)),
        ("long_tail", "use_case_phrase", unique(F.concat(F.slice("problem_phrases", 1, 4), F.slice("usage", 1, 4)))),
        ("long_tail", "audience_phrase", unique(cross(F.slice("audience", 1, 3), two))),
        ("benefit_price", "product_price", _if(F.col("price_allowed"), F.array(_join(F.col("name"), F.lit("가격"))))),
        ("benefit_price", "price_band", F.slice("bands", 1, 4)),
        ("season_event", "grounded_event", unique(cross(F.slice("events", 1, 3), two))),
        ("season_event", "seasonal_context", unique(cross(F.slice("usage", 1, 3), two))),
        ("problem_solution", "problem_noun_phrase", F.slice("problem_phrases", 1, 8)),
        ("competitor_comparison", "competitor_brand_type", unique(cross(F.slice("competitors", 1, 6), two))),
        (dims.NEGATIVE, "negative_exclusion", texts(dims.NEGATIVE_SEEDS[:6])),
    ]
    rows = rows_of(interpreted, F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(dims.SLOT_ORDER[c].index(t)).alias("rank"), F.lit(c).alias("category"), F.lit(t).alias("slot_type"), s.alias("seeds")) for i, (c, t, s) in enumerate(sources)]), "url").select("url", "x.*").where(F.size("seeds") > 0)
    seats = plan.select("url", "category", F.col("seats").cast("int").alias("total")).unionByName(interpreted.select("url", F.lit(dims.NEGATIVE).alias("category"), F.lit(1).alias("total")))
    rows = rows.join(spread(seats), ["url", "category"]).where("total > 0")
    primary = F.col("rank") == F.min("rank").over(Window.partitionBy("url", "category"))
    rows = rows.withColumn("is_primary", primary).withColumn("n", F.size("seeds"))
    split = quota.slot_split(rows.select(F.concat_ws("\x01", "url", "category").alias("key"), "total", F.format_string("%03d:%s", "pos", "slot_type").alias("slot"), F.col("n").alias("seeds"), "is_primary"))
    named = split.select(F.split("key", "\x01")[0].alias("url"), F.split("key", "\x01")[1].alias("category"), F.substring("slot", 5, 100).alias("slot_type"), F.col("seats").alias("target"))
    out = rows.join(spread(named), ["url", "category", "slot_type"]).where("target > 0")
    return out.select("url", "category", "slot_type", "target", F.col("is_primary").alias("required"), F.slice("seeds", 1, 8).alias("seeds"))


def batch_plan(plan: DataFrame) -> DataFrame:
    """Generation batches (url, batch, category, target): one for each category with seats, and one for negatives."""
    own = plan.where("seats > 0").select("url", F.concat(F.lit("category_"), F.col("category")).alias("batch"), "category", F.col("seats").cast("long").alias("target"))
    none_ = plan.select("url").distinct().select("url", F.lit(f"category_{dims.NEGATIVE}").alias("batch"), F.lit(dims.NEGATIVE).alias("category"), F.lit(1).cast("long").alias("target"))
    return own.unionByName(none_)


def weak_batches(batches: DataFrame, rows: DataFrame, mode: str = "both") -> DataFrame:
    """Batches with too few rows: ``missing`` (none of the category) and ``low_volume`` (fewer than max(1, 35 % of the target))."""
    labels = {"naver_sa": F.col("naver_match") != "", "google_sa": F.col("google_match") != "", "both": (F.col("naver_match") != "") | (F.col("google_match") != "")}
    hits = rows.where(labels[mode]).groupBy("url", "category").agg(F.count("*").alias("n"))
    out = batches.join(spread(hits), ["url", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = F.greatest(F.lit(1), F.floor(F.greatest(F.col("target"), F.lit(1)) * 0.35))
    out = out.withColumns({"missing": F.col("n") == 0, "low_volume": F.col("n") < least, "least": least.cast("long")})
    return out.where("missing or low_volume").select("url", "batch", "category", "n", "least", "missing", "low_volume")


def supplement_order(batches: DataFrame, gaps: DataFrame, missing: DataFrame) -> DataFrame:
    """Batches that still lack something, the emptiest first: ``gaps`` (url, category, slot_type, missing), ``missing`` (url, category)."""
    open_ = gaps.where("missing > 0").groupBy("url", "category").agg(F.sum("missing").alias("gap"))
    lacks = missing.select("url", "category", F.lit(1).alias("lacks")).distinct()
    out = batches.join(spread(open_), ["url", "category"], "left").join(spread(lacks), ["url", "category"], "left").where("gap is not null or lacks is not null")
    out = out.withColumns({"gap": F.coalesce("gap", F.lit(0)), "lacks": F.coalesce("lacks", F.lit(0))})
    place = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("gap"), F.desc("lacks"), "batch"))
    return out.select("url", "batch", "gap", "lacks", place.alias("place"))
