"""Queries of the service: jobs closed by keyed state, model answers, golden expectations, plans per product, artifacts and outside calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions import responses
from keyloom.operators import golden, rows, supplement
from keyloom.plans.catalog import _CHOSEN, _TASKS_SQL, _t, _tasks, candidate_rows, query
from keyloom.plans.more import _SLOT_SQL, _slotted
from keyloom.scratch import folder
from keyloom.sources import artifacts
from keyloom.streaming import jobs as closing


@query("Q03_closed_jobs", f"{_TASKS_SQL} SELECT job_id::VARCHAR AS job_id, submitted, cached, succeeded, failed, status FROM stat WHERE open = 0")
def q03c(spark, d):
    """The keyed state of the stream over a table of events: a registration for each task, and an end for those that have one, every third one twice."""
    tasks = _tasks(spark, d)
    sizes = tasks.groupBy("job_id").agg(F.count("*").alias("submitted"))
    times = F.when(F.col("status") == "RECEIVED", F.array(F.lit("RECEIVED"))).when(F.col("task_id") % 3 == 0, F.array(F.col("status"), F.lit("RECEIVED"), F.col("status"))).otherwise(F.array(F.lit("RECEIVED"), F.col("status")))
    events = tasks.join(sizes, "job_id").select(F.col("job_id").cast("string").alias("job_id"), F.col("task_id").cast("string").alias("task_id"), F.posexplode(times).alias("k", "status"), "submitted").withColumn("ts", F.timestamp_seconds("k"))
    return closing.finished(events).select("job_id", "submitted", "cached", "succeeded", "failed", "status")


#: Candidates of every product have the same ids and places; what answers say of them is a wording of their own, a refusal, or an id.
_CANDIDATES = "SELECT p_partkey AS url, x.i AS intent_id, x.o AS ord, x.c AS category, x.k AS keyword FROM (SELECT p_partkey, unnest([{'i': 'c0', 'o': 0, 'c': 'brand', 'k': p_name}, {'i': 'c1', 'o': 1, 'c': 'long_tail', 'k': p_type || ' ' || p_size}, {'i': NULL, 'o': 2, 'c': 'benefit_price', 'k': p_brand || ' 가격'}, {'i': 'c3', 'o': 3, 'c': 'brand', 'k': 'only ' || p_name}]) AS x FROM part)"
_ANSWERS = "SELECT p_partkey AS url, x.p AS place, x.i AS intent_id, x.c AS category, x.k AS keyword, x.s AS score FROM (SELECT p_partkey, p_size, unnest([{'p': 0, 'i': CASE WHEN p_size % 3 = 0 THEN 'c0' ELSE 'zz' END, 'c': 'brand', 'k': '', 's': 'high'}, {'p': 1, 'i': 'zz', 'c': 'long_tail', 'k': 'best ' || p_type || ' ' || p_size, 's': 'medium'}, {'p': 2, 'i': '', 'c': 'benefit_price', 'k': p_brand || ' 가격', 's': 'high'}, {'p': 3, 'i': 'c1', 'c': 'x', 'k': 'x', 's': 'low'}, {'p': 4, 'i': 'none', 'c': 'brand', 'k': CASE WHEN p_size % 5 = 0 THEN 'only' ELSE 'nowhere' END, 's': 'low'}]) AS x FROM part) WHERE x.p <> 3 OR p_size % 2 = 0"
_MADE_ID = "substr(sha1(%s.category || '|' || %s.keyword), 1, 16)"


@query(
    "R05_survivors",
    f"WITH c AS (SELECT *, coalesce(intent_id, {_MADE_ID % ('k', 'k')}) AS id FROM ({_CANDIDATES}) k), a AS ({_ANSWERS}), "
    f"m AS (SELECT a.url, a.place, a.score, coalesce((SELECT min(ord) FROM c WHERE c.url = a.url AND c.id = a.intent_id), (SELECT min(ord) FROM c WHERE c.url = a.url AND a.keyword <> '' AND c.id = {_MADE_ID % ('a', 'a')}), (SELECT min(ord) FROM c WHERE c.url = a.url AND a.keyword <> '' AND (contains(c.keyword, a.keyword) OR contains(a.keyword, c.keyword)))) AS ord FROM a) "
    "SELECT m.url, m.ord, any_value(c.keyword) AS keyword, arg_max(m.score, m.place) AS quality_score FROM m JOIN c ON c.url = m.url AND c.ord = m.ord GROUP BY m.url, m.ord",
)
def r05(spark, d):
    p = _t(spark, d, "part").withColumn("url", F.col("p_partkey"))
    item = lambda i, o, c, k: F.struct(F.lit(i).cast("string").alias("intent_id"), F.lit(o).alias("ord"), F.lit(c).alias("category"), k.alias("keyword"))
    kinds = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"))
    price = F.concat("p_brand", F.lit(" 가격"))
    candidates = p.select("url", F.inline(F.array(item("c0", 0, "brand", F.col("p_name")), item("c1", 1, "long_tail", kinds), item(None, 2, "benefit_price", price), item("c3", 3, "brand", F.concat(F.lit("only "), "p_name")))))
    said = lambda i, c, k, s, keep=None: F.struct((i if hasattr(i, "cast") else F.lit(i)).alias("intent_id"), F.lit(c).alias("category"), k.alias("keyword"), F.lit(s).alias("quality_score"), (F.lit(True) if keep is None else keep).alias("keep"))
    items = F.array(
        said(F.when(F.col("p_size") % 3 == 0, "c0").otherwise("zz"), "brand", F.lit(""), "high"),
        said("zz", "long_tail", F.concat(F.lit("best "), kinds), "medium"),
        said("", "benefit_price", price, "high"),
        said("c1", "x", F.lit("x"), "low", F.col("p_size") % 2 == 0),
        said("none", "brand", F.when(F.col("p_size") % 5 == 0, "only").otherwise("nowhere"), "low"),
    )
    answer = F.concat(F.lit('Here: {"dropped_duplicates":[{"intent_text":"x"}],"result":{"surviving":'), F.to_json(items), F.lit("}} done"))
    # the outer object is met first, so the answer stands alone on every other product
    answer = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"surviving":'), F.to_json(items), F.lit(',"dropped_duplicates":[{"intent_text":"x"}]}'))).otherwise(F.regexp_replace(answer, r'"dropped_duplicates":\[\{"intent_text":"x"\}\],', '"notes":["surviving"],'))
    made = responses.reports(p.select("url", answer.alias("answer")))
    return responses.surviving(candidates, responses.answered_rows(made, ["url"]), ["url"]).select("url", "ord", "keyword", "quality_score")


_NORMAL = "trim(regexp_replace(lower(%s), '[|/_\\s]+', ' ', 'g'))"


@query(
    "A13_golden_findings",
    f"{_CHOSEN}, shown AS (SELECT url AS case_id, p.platform, ord, category, keyword, {_NORMAL % 'keyword'} AS form FROM (SELECT url, ord, category, keyword, unnest([{{'platform': 'naver_sa', 'label': naver_match}}, {{'platform': 'google_sa', 'label': google_match}}]) AS p FROM chosen WHERE category <> 'negative') WHERE p.label <> ''), "
    "first AS (SELECT case_id, platform, form, arg_min(keyword, ord) AS keyword FROM shown GROUP BY ALL), "
    "part_ AS (SELECT 'https://shop.example.com/product/' || p_partkey AS case_id, *, p.platform AS platform FROM (SELECT *, unnest([{'platform': 'naver_sa'}, {'platform': 'google_sa'}]) AS p FROM part) WHERE p_size % 4 <> 0 OR p.platform = 'naver_sa'), "
    f"keep AS (SELECT case_id, platform, unnest([p_name, p_name || ' | ' || p_type]) AS v FROM part_), ban AS (SELECT case_id, platform, p_name AS v FROM part_ WHERE p_size % 2 = 0), frag AS (SELECT case_id, platform, unnest(['추천', '_' || p_type]) AS v FROM part_), cat AS (SELECT case_id, platform, unnest(['brand', 'season_event', 'nothing']) AS v FROM part_) "
    f"SELECT case_id, platform, 'missing_must_keep' AS finding, v AS value FROM keep WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.case_id = keep.case_id AND f.platform = keep.platform AND f.form = {_NORMAL % 'keep.v'}) "
    f"UNION ALL SELECT f.case_id, f.platform, 'emitted_forbidden_keyword', f.keyword FROM first f SEMI JOIN ban ON f.case_id = ban.case_id AND f.platform = ban.platform AND f.form = {_NORMAL % 'ban.v'} "
    f"UNION ALL SELECT DISTINCT f.case_id, f.platform, 'emitted_forbidden_substring', f.keyword FROM first f JOIN frag ON f.case_id = frag.case_id AND f.platform = frag.platform WHERE contains(f.form, {_NORMAL % 'frag.v'}) "
    "UNION ALL SELECT case_id, platform, 'missing_category', v FROM cat WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.case_id = cat.case_id AND s.platform = cat.platform AND s.category = cat.v)",
)
def a13f(spark, d):
    """Every product is a case: two names to keep, its bare name banned for half of them, two fragments, three categories; a fourth asks for one platform."""
    chosen = rows.select_rows(rows.selection_scores(candidate_rows(spark, d)), 12)
    p = _t(spark, d, "part").withColumn("case_id", F.concat(F.lit("https://shop.example.com/product/"), "p_partkey"))
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    values = F.array_compact(
        F.array(
            one("must_keep", F.col("p_name")),
            one("must_keep", F.concat("p_name", F.lit(" | "), "p_type")),
            F.when(F.col("p_size") % 2 == 0, one("must_not_emit", F.col("p_name"))),
            one("forbidden_substrings", F.lit("추천")),
            one("forbidden_substrings", F.concat(F.lit("_"), "p_type")),
            *[one("required_categories", F.lit(c)) for c in ("brand", "season_event", "nothing")],
        )
    )
    expected = p.select("case_id", F.explode(values).alias("x")).select("case_id", F.explode(F.array(F.lit("naver_sa"), F.lit("google_sa"))).alias("platform"), "x.kind", "x.value")
    modes = p.select("case_id", F.when(F.col("p_size") % 4 == 0, "naver_sa").otherwise("both").alias("mode"))
    return golden.findings(chosen, expected, modes)


@query("S06_manifested_results", "SELECT s_nationkey::VARCHAR AS job_id, s_suppkey::VARCHAR AS url_task_id, CASE WHEN s_suppkey % 3 = 0 THEN 'FAILED_GENERATION' ELSE 'COMPLETED' END AS status, s_name AS keyword, CASE WHEN s_nationkey % 2 = 0 AND EXISTS (SELECT 1 FROM supplier o WHERE o.s_nationkey = s.s_nationkey AND o.s_suppkey % 3 <> 0) THEN 'combined' ELSE 'manifest' END AS source FROM supplier s WHERE s_nationkey % 2 = 1 OR s_suppkey % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM supplier o WHERE o.s_nationkey = s.s_nationkey AND o.s_suppkey % 3 <> 0)")
def s06(spark, d):
    """A nation is a job, its suppliers are tasks: all in a manifest, every other job's combined file missing."""
    s = _t(spark, d, "supplier")
    row = F.struct(*[(F.col("s_name") if c == "keyword" else F.lit(False) if c == "quality_warning" else F.lit("")).alias(c) for c in dims.EXPORT_COLUMNS])
    results = s.select(F.col("s_nationkey").cast("string").alias("job_id"), F.col("s_suppkey").cast("string").alias("url_task_id"), F.concat(F.lit("https://x.com/"), "s_suppkey").alias("raw_url"), F.lit("commerce_pdp").alias("page_class"), F.when(F.col("s_suppkey") % 3 == 0, "FAILED_GENERATION").otherwise("COMPLETED").alias("status"), F.lit(None).cast("string").alias("failure_code"), F.array(row).alias("rows"))
    at = folder(spark)
    artifacts.write_items(results, at)
    artifacts.write_combined(results.where(F.col("job_id").cast("int") % 2 == 0), at)
    return artifacts.read_jobs(spark, at).select("job_id", "url_task_id", "status", F.col("rows")[0]["keyword"].alias("keyword"), "source")


_SLOTS = [*dims.DEFAULT_SLOTS.items()]
_TARGETS = (
    f"{_SLOT_SQL}, half AS (SELECT * FROM sl WHERE ord % 2 = 0), slot(place, category, slot_type) AS (VALUES " + ", ".join(f"({i}, '{c}', '{s}')" for i, (c, s) in enumerate(_SLOTS)) + "), "
    "plan AS (SELECT 'https://shop.example.com/product/' || p_partkey AS url, place, category, slot_type, 1 + (p_partkey + place) % 5 AS target, (p_partkey + place) % 4 <> 0 AS required FROM part CROSS JOIN slot), "
    "c AS (SELECT url, category, slot_type, count(*) FILTER (naver_match <> '') AS n, count(*) FILTER (google_match <> '') AS g FROM half GROUP BY ALL), "
    "gap AS (SELECT p.*, target - least(coalesce(n, 0), coalesce(g, 0)) AS gap FROM plan p LEFT JOIN c ON c.url = p.url AND c.category = p.category AND c.slot_type = p.slot_type), "
    "k AS (SELECT url, category, sum(n) AS n, sum(g) AS g FROM c GROUP BY ALL), lack AS (SELECT p.url, p.category, p.slot_type FROM plan p LEFT JOIN k ON k.url = p.url AND k.category = p.category WHERE coalesce(k.n, 0) = 0 OR coalesce(k.g, 0) = 0), "
    "asked AS (SELECT url, category, slot_type FROM lack UNION SELECT url, category, slot_type FROM gap g WHERE gap > 0 AND NOT EXISTS (SELECT 1 FROM lack l WHERE l.url = g.url AND l.category = g.category AND l.category <> 'negative')), "
    "have AS (SELECT u.url, greatest(0, 40 - coalesce(sum(n) FILTER (category <> 'negative'), 0), 40 - coalesce(sum(g) FILTER (category <> 'negative'), 0)) AS short FROM (SELECT DISTINCT url FROM plan) u LEFT JOIN k ON k.url = u.url GROUP BY u.url), "
    "lef AS (SELECT h.url, greatest(0, short - (SELECT count(*) FROM asked a WHERE a.url = h.url AND a.category <> 'negative')) AS rest FROM have h), "
    "w AS (SELECT p.*, l.rest, greatest(1, p.target * l.rest // sum(p.target) OVER (PARTITION BY p.url)) AS extra, CASE WHEN a.url IS NULL THEN 0 ELSE 1 END AS named FROM plan p JOIN lef l ON l.url = p.url AND l.rest > 0 LEFT JOIN asked a ON a.url = p.url AND a.category = p.category AND a.slot_type = p.slot_type WHERE p.required AND p.category <> 'negative'), "
    "x AS (SELECT *, named + extra AS now, greatest(0, sum(extra) OVER (PARTITION BY url) - rest) AS surplus, coalesce(sum(named + extra - 1) OVER (PARTITION BY url ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM w), "
    "y AS (SELECT url, category, slot_type, now - least(now - 1, greatest(0, surplus - off)) AS target FROM x), "
    "z AS (SELECT coalesce(a.url, y.url) AS url, coalesce(a.category, y.category) AS category, coalesce(a.slot_type, y.slot_type) AS slot_type, coalesce(y.target, 1)::BIGINT AS target FROM asked a FULL JOIN y ON a.url = y.url AND a.category = y.category AND a.slot_type = y.slot_type) "
    "SELECT *, (sum(target) OVER (PARTITION BY url))::BIGINT AS total FROM z"
)


@query("A03_supplement_targets", _TARGETS)
def a03s(spark, d):
    """What every product's rows lack against a plan of its own, forty positive rows wanted."""
    half = _slotted(spark, d).where("ord % 2 = 0")
    slot = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("category"), F.lit(s).alias("slot_type")) for i, (c, s) in enumerate(_SLOTS)])
    at = F.col("p_partkey") + F.col("x.place")
    plan = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("https://shop.example.com/product/"), "p_partkey").alias("url"), F.explode(slot).alias("x")).select("url", "x.*", (at % 5 + 1).cast("int").alias("target"), (at % 4 != 0).alias("required"))
    return supplement.targets(plan.select("url").distinct(), half, plan, 40)
