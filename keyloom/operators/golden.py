"""Golden expectations held against keyword rows: what must be there, what must not, and categories.

Fragments are found by one automaton over all distinct fragments, which reads every distinct keyword once. It goes to
the tasks whole, so its size is checked first; more fragments are drawn from an index of substrings and joined.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from keyloom import dims
from keyloom.functions.responses import contained
from keyloom.functions.tables import spread
from keyloom.operators.rows import by_platform
from keyloom.workers import ready

KINDS = {"must_keep": "missing_must_keep", "must_not_emit": "emitted_forbidden_keyword", "forbidden_substrings": "emitted_forbidden_substring", "required_categories": "missing_category"}
#: Fragments, and code points of them, that an automaton may hold.
MOST_FRAGMENTS, MOST_CHARS = 100_000, 4_000_000


def normal(text: str | None) -> str:
    """Compatibility form, separators as spaces, full case folding, single spaces."""
    folded = unicodedata.normalize("NFKC", text or "")
    for mark in "|/_":
        folded = folded.replace(mark, " ")
    return " ".join(folded.casefold().split())


@F.pandas_udf(StringType())
def normal_form(text: pd.Series) -> pd.Series:
    return text.map(normal)


def fragments_in(texts: DataFrame, fragments: DataFrame, most: int = MOST_FRAGMENTS) -> DataFrame:
    """Which of the fragments (column ``fragment``) each text (column ``text``) holds: distinct pairs of both. Empty fragments are in every text."""
    texts, fragments = texts.select("text").where("text is not null").distinct(), fragments.select("fragment").where("fragment is not null").distinct()
    size = fragments.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("fragment")), F.lit(0)).alias("chars")).first()
    if not size.n:
        return texts.select("text", F.lit("").alias("fragment")).limit(0)
    if size.n > most or size.chars > MOST_CHARS:
        every = F.lit(1).alias("one")
        return contained(fragments.select("fragment", F.col("fragment").alias("s"), every), texts.select(F.col("text").alias("t"), every), ["one"]).select(F.col("t").alias("text"), "fragment")
    words = [r.fragment for r in fragments.collect()]  # bounded just above
    schema = StructType([StructField("text", StringType()), StructField("found", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            if w:
                machine.add_word(w, w)
        empty = [""] if "" in words else []
        machine.make_automaton()
        for b in batches:
            found = [empty + sorted({w for _, w in machine.iter(t)}) if len(machine) else empty for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=schema.names)

    return ready(texts).mapInArrow(run, schema).select("text", F.explode("found").alias("fragment"))


def findings(rows: DataFrame, expected: DataFrame, modes: DataFrame | None = None, most: int = MOST_FRAGMENTS) -> DataFrame:
    """What rows (url, ord, category, keyword, naver_match, google_match) miss or must not have: case_id, platform, finding, value.

    ``expected``: case_id, platform, kind (KINDS), value, where ``case_id`` is the url of the rows; ``modes`` (case_id, mode) leaves platforms out that a case
    doesn't ask for. Negative rows don't count. Equal findings in the normal form stay once, as they stand in the first row.
    """
    wanted = ready(expected).select("case_id", "platform", "kind", "value").where("value is not null").distinct()
    if modes is not None:
        asked = modes.select("case_id", "mode").distinct()
        wanted = wanted.join(spread(asked), "case_id").where((F.col("mode") == "both") | (F.col("mode") == F.col("platform"))).drop("mode")
    wanted = wanted.withColumn("form", normal_form("value"))
    shown = by_platform(ready(rows).where(F.col("category") != dims.NEGATIVE)).select(F.col("url").alias("case_id"), "platform", "ord", "category", "keyword").withColumn("form", normal_form("keyword"))
    key = ["case_id", "platform"]
    first = shown.groupBy(*key, "form").agg(F.min_by("keyword", "ord").alias("keyword"))
    of = lambda kind: wanted.where(F.col("kind") == kind)
    say = lambda df, kind, value: df.select(*key, F.lit(KINDS[kind]).alias("finding"), F.col(value).alias("value"))
    missing = say(of("must_keep").join(spread(first), [*key, "form"], "left_anti"), "must_keep", "value")
    emitted = say(first.join(spread(of("must_not_emit").select(*key, "form").distinct()), [*key, "form"], "left_semi"), "must_not_emit", "keyword")
    banned = of("forbidden_substrings").select(*key, F.col("form").alias("fragment")).distinct()
    pairs = fragments_in(first.select(F.col("form").alias("text")), banned, most).withColumnRenamed("text", "form")
    held = first.join(spread(pairs), "form").join(spread(banned), [*key, "fragment"], "left_semi").select(*key, "keyword").distinct()
    categories = shown.select(*key, F.col("category").alias("value")).distinct()
    lacking = say(of("required_categories").join(spread(categories), [*key, "value"], "left_anti"), "required_categories", "value")
    return missing.unionByName(emitted).unionByName(say(held, "forbidden_substrings", "keyword")).unionByName(lacking)
