"""Array expressions that stay linear, or n log n, in the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import dims

#: White space; what it is not in nearly every text (ASCII signs, Hangul) is told by the first test of a character.
SPACE = rf"[[^!-~\x{{3131}}-\x{{d79d}}]&&{dims.SPACE}]"
#: The same characters as a text.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def texts(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else none()


def collapse(text: Column) -> Column:
    """Words with one space between them; a lone space is no match, so most texts are left as they are."""
    return F.trim(F.regexp_replace(text, f"{SPACE}(?:{SPACE}+|(?<! ))", " "))


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.trim(text, F.lit(SPACES))


def words_of(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order."""
    tagged = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"]))
    return let(tagged, lambda s: F.transform(F.sort_array(F.transform(first(s), lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"]))


def unique(values: Column, most: int | None = None) -> Column:
    """First of each text without regard to case, white space collapsed, in order; empty and null ones go."""
    out = first_of_each(F.filter(F.transform(values, collapse), lambda v: F.coalesce(v, F.lit("")) != ""), F.lower)
    return F.slice(out, 1, most) if most else out


def named(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, in order; the names differ.

    Without a lambda: below one, Spark would interpret all that the rules are made of instead of compiling it.
    """
    return F.array_except(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), F.array(F.lit(None).cast("string")))


def any_in(text: Column, parts: Column) -> Column:
    """Whether a text holds any of the parts (an array); the text is computed once, not once a part."""
    return let(text, lambda x: F.exists(parts, lambda p: F.contains(x, p)))


def rows_of(df: DataFrame, items: Column, *names: str, item: str = "x", place: str | None = None) -> DataFrame:
    """One row for each item of an array, beside the columns ``names``, with its place from 0 if asked for.

    The outer form keeps the optimizer from pushing a test of the array's size, and with it a copy of
    everything the array is made of, down through the projections below.
    """
    out = df.select(*names, F.posexplode_outer(items).alias(place or "place_", item)).where(F.col(place or "place_").isNotNull())
    return out if place else out.drop("place_")


def where_here(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns, tested above them.

    A plain filter would be pushed down through every projection, each time with a copy of all that its columns are made of;
    what a generator puts out is not.
    """
    return df.select("*", F.explode_outer(F.array(condition)).alias("keep_")).where("keep_").drop("keep_")
