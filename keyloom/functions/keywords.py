"""Keyword expressions: tokens, policy predicates, signatures and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.arrays import let

EVAL_TOKEN = "[A-Za-z0-9가-힣]+"
POLICY_TOKEN = "[A-Za-z0-9가-힣]+(?:'[A-Za-z0-9가-힣]+)?"
FAMILY_TOKEN = "[A-Za-z0-9]+|[가-힣]+"
MEASURE = r"(?:^|[^\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?\s?(?:" + "|".join(dims.UNITS) + r")(?:[^\p{L}\p{N}_]|$)"

#: A measure and nothing else.
UNIT_ONLY = r"^[0-9]+(?:\.[0-9]+)?\s?(?:" + "|".join((*dims.UNITS, "형")) + ")$"


def words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(keyword: Column, pattern: str = POLICY_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(keyword), F.lit(f"({pattern})"), F.lit(1))


def has_any(text: Column, values: tuple[str, ...]) -> Column:
    """Whether a text holds any of the values; the text is computed once, not once a value."""
    return let(text, lambda x: F.exists(words(values), lambda v: F.contains(x, v)))


def holds(text: Column, values: tuple[str, ...]) -> Column:
    """The same of a column that is computed already: compiled, without a lambda."""
    out = F.contains(text, F.lit(values[0]))
    for v in values[1:]:
        out = out | F.contains(text, F.lit(v))
    return out


def token_in(toks: Column, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(toks, words(values))


def repeated_phrase(keyword: Column) -> Column:
    """Two equal halves, equal neighbours, a token three times, or equal ends (numbers aside)."""
    return repeated_tokens(tokens(keyword))


def repeated_tokens(t: Column) -> Column:
    """The same of a column of tokens; for long texts make that a column of its own first."""
    number = lambda x: x.rlike("^[0-9]+$")
    rest = lambda a, skip: F.greatest(F.size(a) - skip, F.lit(0))
    shifted = lambda a, skip, f: F.array_contains(F.zip_with(F.slice(a, 1, rest(a, skip)), F.slice(a, skip + 1, rest(a, skip)), f), True)
    n = F.size(t)
    half = F.greatest(n / 2, F.lit(1)).cast("int")
    halves = (n >= 4) & (n % 2 == 0) & (F.slice(t, 1, half) == F.slice(t, half + 1, F.greatest(n, F.lit(1))))
    neighbours = shifted(t, 1, lambda x, y: (x == y) & ~number(x))
    thrice = lambda w: shifted(F.sort_array(w), 2, lambda x, y: x == y)  # noqa: E731 - in sorted order a token that stands three times does so in a row
    ends = lambda w: F.try_element_at(w, F.lit(1)) == F.try_element_at(w, F.lit(-1))
    words_ = F.filter(t, lambda x: ~number(x))
    return halves | neighbours | ((n >= 3) & let(words_, lambda w: (F.size(w) >= 3) & (thrice(w) | ends(w))))


def placeholder_unit(keyword: Column, t: Column | None = None) -> Column:
    """``t``, here and below: the keyword's tokens, where they are a column already."""
    return token_in(tokens(keyword) if t is None else t, dims.UNITS)


def boilerplate(keyword: Column, low: Column | None = None) -> Column:
    """``low``, here and below: the keyword in lower case, where that is a column already."""
    return has_any(F.lower(keyword), dims.DOC_BOILERPLATE) if low is None else holds(low, dims.DOC_BOILERPLATE)


def low_information(keyword: Column, t: Column | None = None, low: Column | None = None) -> Column:
    """Whether a keyword says little: an empty word, boilerplate, a unit, or its first part twice."""
    if low is None:
        return let(F.lower(keyword), lambda x: low_information(keyword, t, x))
    twice = low.rlike(r"^\s*(\S+)\s+\1(?:\s|\z)")
    return holds(low, dims.LOW_INFORMATION) | boilerplate(keyword, low) | placeholder_unit(keyword, t) | F.coalesce(twice, F.lit(False))


def occurrences(text: Column, part: Column) -> Column:
    return F.when(part == "", 0).otherwise((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1)))


def invalid_exact(keyword: Column, category: Column, product: Column, short: Column, brand: Column, t: Column | None = None, low: Column | None = None) -> Column:
    """Whether a keyword may not carry an exact label."""
    low, t = F.lower(keyword) if low is None else low, tokens(keyword) if t is None else t
    allowed = F.lower(product).eqNullSafe(low) | F.lower(short).eqNullSafe(low) | F.lower(brand).eqNullSafe(low) | (F.lower(F.concat(brand, F.lit(" "), short)) == low)
    return (
        F.when(allowed & (low != ""), False)
        .when(F.size(t) == 0, True)
        .when(F.size(F.array_distinct(t)) != F.size(t), True)
        .when(occurrences(low, F.lower(product)) > 1, True)
        .when((short != product) & (occurrences(low, F.lower(short)) > 1), True)
        .when(low.rlike(MEASURE), True)
        .when(F.size(t) == 1, (brand != "") & (low != F.lower(brand)))
        .otherwise((category == "brand") & (brand != "") & ~F.contains(low, F.lower(brand)) & (F.size(t) <= 2))
    )


def short_name(product: Column, brand: Column) -> Column:
    return F.when((brand != "") & F.contains(product, F.lit(" ")) & (F.lower(F.substring_index(product, " ", 1)) == F.lower(brand)), F.substring(product, F.instr(product, " ") + 1, F.lit(100000))).otherwise(product)


def strip_tail(toks: Column, values: tuple[str, ...]) -> Column:
    """Tokens without the trailing ones that are in ``values``."""
    keep = F.aggregate(F.transform(toks, lambda x, i: F.when(x.isin(*values), 0).otherwise(i + 1)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(toks, F.lit(1), keep)


def semantic_signature(keyword: Column, t: Column | None = None) -> Column:
    """The tokens without suffixes, then without fillers at the end; all of them if that leaves none. Tokens hold no space, so they are cut off as text."""
    text = F.array_join(tokens(keyword, EVAL_TOKEN) if t is None else t, " ")
    cut = text
    for values in (dims.DUPLICATE_SUFFIXES, dims.LIGHT_FILLERS):
        cut = F.regexp_replace(cut, "(?:(?:^| )(?:" + "|".join(values) + "))+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), text)


def family_key(keyword: Column) -> Column:
    return F.array_join(F.slice(F.filter(tokens(keyword, FAMILY_TOKEN), lambda x: ~x.isin(*dims.SELECTION_MODIFIERS)), 1, 2), " ")


def filler(keyword: Column, t: Column | None = None) -> Column:
    """A filler suffix anywhere, a number at the end, or two filler words."""
    t = tokens(keyword, EVAL_TOKEN) if t is None else t
    return holds(keyword, dims.FILLER_SUFFIXES) | F.trim(keyword).rlike(r"(?:^|\s)[0-9]+$") | ((F.size(t) >= 2) & (F.size(F.filter(t, lambda x: x.isin(*dims.LIGHT_FILLERS))) >= 2))


def naturalness(keyword: Column, support_page: Column, t: Column | None = None, filled: Column | None = None) -> Column:
    """Hundredths from 0 to 100; ``filled``: what ``filler`` says, where that is a column already."""
    t = tokens(keyword, EVAL_TOKEN) if t is None else t
    n = F.size(t)
    cost = [
        F.when(filler(keyword, t) if filled is None else filled, 60),
        F.when(F.size(F.array_distinct(t)) != n, 20),
        F.when(F.length(F.replace(keyword, F.lit(" "), F.lit(""))) <= 2, 30),
        F.when(n >= 9, 10),
        F.when(n >= 11, 10),
        F.when(token_in(t, dims.EVAL_BOILERPLATE), 40),
        F.when(~support_page & (F.length(keyword) > 28), 10),
        F.when((n >= 4) & (F.size(F.filter(t, lambda x: x.isin(*dims.MODIFIERS))) >= 4), 15),
    ]
    total = F.lit(0)
    for c in cost:
        total = total + F.coalesce(c, F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - total)


def naver_label(category: Column) -> Column:
    return F.when(category == dims.NEGATIVE, "제외키워드").when(category.isin("brand", "purchase_intent"), "완전일치").otherwise("확장소재")


def google_label(category: Column) -> Column:
    return F.when(category == dims.NEGATIVE, "negative").when(category == "brand", "exact").when(category.isin("long_tail", "purchase_intent", "problem_solution"), "phrase").otherwise("broad")


def price_bands(price: Column) -> Column:
    """``3만원대`` and ``30,000원대`` of a price in won; none under 10,000."""
    band = F.floor(price / 10000)
    return F.when(band >= 1, F.array(F.concat(band.cast("string"), F.lit("만원대")), F.concat(F.format_number(band * 10000, 0), F.lit("원대")))).otherwise(F.array().cast("array<string>"))
