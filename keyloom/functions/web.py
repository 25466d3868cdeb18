"""URL and HTML expressions: columns in, columns out, inside the JVM."""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.arrays import collapse, let, none, stripped, unique

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Longest entity name that counts without its semicolon.
_BARE = max(len(n) for n in html5 if not n.endswith(";"))


def _quoted(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


@cache
def _entities() -> str:
    """The named entities as one text, from the standard library's table."""
    return "\x01".join(f"{name}\x02{sign}" for name, sign in html5.items())


def _numbered(code: Column) -> Column:
    """The character of a numeric reference; some codes stand for others, for a replacement sign, or for nothing."""
    sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    latin = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | ((code % 0x10000) >= 0xFFFE)
    return (
        F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), F.substring(F.lit(latin), (code - 0x7F).cast("int"), F.lit(1)))
        .when(control, F.lit(""))
        .otherwise(sign)
    )


def _resolved(part: Column, table: Column) -> Column:
    """What stands after an ampersand, with its reference resolved; ``table``: signs by name."""

    def one(name: Column) -> Column:
        rest = F.substring(part, F.length(name) + 1, F.length(part))
        digits = F.regexp_replace(name, "[#;xX]", "")
        code = F.when(name.rlike("^#[xX]"), F.conv(F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, digits), 16, 10)).otherwise(digits).try_cast("bigint")
        cut = F.sequence(F.least(F.length(name) - 1, F.lit(_BARE)), F.lit(2), F.lit(-1))
        start = F.transform(F.when(F.length(name) > 2, cut).otherwise(none("int")), lambda n: F.concat(F.try_element_at(table, F.substring(name, F.lit(1), n)), F.substring(name, n + 1, F.length(name))))
        named = F.coalesce(F.try_element_at(table, name), F.get(F.array_compact(start), F.lit(0)), F.concat(F.lit("&"), name))
        return F.concat(F.when(name.startswith("#"), _numbered(code)).otherwise(named), rest)

    return F.when(F.regexp_extract(part, _REFERENCE, 1) == "", F.concat(F.lit("&"), part)).otherwise(let(F.regexp_extract(part, _REFERENCE, 1), one))


def unescape(text: Column) -> Column:
    """All character references resolved, as browsers do (names without a semicolon included)."""
    table = F.str_to_map(F.lit(_entities()), F.lit("\x01"), F.lit("\x02"))
    whole = lambda p, t: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x: _resolved(x, t)), ""))
    return let(text, lambda x: F.when(F.contains(x, F.lit("&")), let(table, lambda t: let(F.split(x, "&", -1), lambda p: whole(p, t)))).otherwise(x))


def host(url: Column) -> Column:
    """Lower-case host without user part and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 2)), "^.*@", ""), ":[0-9]*$", "")


def _decoded(text: Column) -> Column:
    """Percent escapes and plus signs resolved; what is no escape stays as it is."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    """Form encoding: letters, digits and ``_.-~`` as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, user part, fragment or tracking keys; one slash between path parts; pairs with a value, sorted."""
    url = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    whole = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    scheme = F.lower(F.regexp_extract(url, _PARTS, 1))
    port = F.regexp_extract(F.regexp_extract(url, _PARTS, 2), ":([0-9]+)$", 1).try_cast("int")
    default = port.isNull() | (port == 0) | ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    bare = F.regexp_extract(url, r"^([^?#]*)(?:\?([^#]*))?", 1)
    path = F.regexp_replace(F.when(whole, F.regexp_extract(url, _PARTS, 3)).otherwise(bare), "/+", "/")
    path = F.when(path == "", "/").when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    raw = F.when(whole, F.regexp_extract(url, _PARTS, 4)).otherwise(F.regexp_extract(url, r"^([^?#]*)(?:\?([^#]*))?", 2))
    split = F.transform(F.split(raw, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.substr(F.instr(p, "=") + 1, F.length(p)).alias("v"), F.contains(p, F.lit("=")).alias("pair")))
    pairs = F.transform(F.filter(split, lambda p: p["pair"] & (p["v"] != "")), lambda p: F.struct(_decoded(p["k"]).alias("k"), _decoded(p["v"]).alias("v")))
    kept = F.filter(pairs, lambda p: ~p["k"].isin(*dims.TRACKING_KEYS) & ~p["k"].startswith("utm_"))
    query = F.array_join(F.transform(F.sort_array(kept), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    site = F.when(whole, F.concat(scheme, F.lit("://"), host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port.cast("string"))))).otherwise("")
    return F.concat(site, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def cache_key(canonical: Column, platform: str, policy: str = "v1", taxonomy: str = "v1", generator: str = "v1") -> Column:
    return F.concat(F.lit("kwg:"), F.sha2(canonical, 256), F.lit(f":platform:{platform}:policy:{policy}:taxonomy:{taxonomy}:generator:{generator}"))


def intent_id(category: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", category, text).cast("binary")), 1, 16)


def host_brand(url: Column, known: dict[str, str] = dims.KNOWN_HOSTS) -> Column:
    """Brand named by a host: a known host, none for a marketplace, else the label before the last (before ``co``), capitalised."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: (x != "") & (x != "www"))
    n = F.size(labels)
    candidate = F.when(n >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(F.try_element_at(labels, F.lit(1)))
    candidate = F.when((candidate == "co") & (n >= 3), F.try_element_at(labels, F.lit(-3))).otherwise(candidate)
    named = F.when(F.length(candidate) > 2, F.concat(F.upper(F.substring(candidate, 1, 1)), F.substring(candidate, 2, 1000))).otherwise(F.upper(candidate))
    out = F.when(F.arrays_overlap(labels, _quoted(dims.EVIDENCE_MARKETPLACES)), F.lit(None)).otherwise(named)
    if known:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        out = F.coalesce(F.get(F.filter(F.transform(labels, lambda x: F.try_element_at(table, x)), lambda b: b.isNotNull()), F.lit(0)), out)
    return F.when(n > 0, out)


def policy_host_brand(url: Column) -> Column:
    """First host label that is no noise word; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(host(url), r"\."), lambda x: (x != "") & ~x.isin(*dims.HOST_NOISE)), F.lit(1)), F.lit(""))


def first_group(html: Column, pattern: str) -> Column:
    """First match's group, entities resolved and white space collapsed; null if empty."""
    return F.nullif(collapse(unescape(F.regexp_extract(html, "(?is)" + pattern, 1))), F.lit(""))


def title(html: Column) -> Column:
    return first_group(html, "<title[^>]*>(.*?)</title>")


def meta(html: Column, name: str, attribute: str = "name") -> Column:
    """Content of the first ``meta`` tag whose name (or property) stands before its content."""
    return first_group(html, f"<meta[^>]+{attribute}=[\"']{name}[\"'][^>]+content=[\"'](.*?)[\"']")


def canonical_link(html: Column) -> Column:
    return first_group(html, "<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"'](.*?)[\"']")


def page_language(html: Column) -> Column:
    return first_group(html, "<html[^>]+lang=[\"']([^\"']+)[\"']")


def visible_text(html: Column) -> Column:
    out = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, f"(?s)<(?i:{tag}).*?>.*?</(?i:{tag})>", " ")
    return _tidied(unescape(F.regexp_replace(out, "<[^>]+>", "\n")))


def _tidied(text: Column) -> Column:
    # a lone space is no match, so most texts are left as they are
    text = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), "[ \t](?:[ \t]+|(?<!\x20))", " "), "\n{2,}", "\n")
    return stripped(text)


def blocks(text: Column, most: int = 20) -> Column:
    """Lines that hold a letter or digit, white space collapsed, the first ``most``."""
    lines = F.transform(F.split(text, "\n+"), collapse)
    return F.slice(F.filter(lines, lambda x: x.rlike("[A-Za-z0-9\\x{3131}-\\x{D79D}]")), 1, most)


def markdown_text(text: Column) -> Column:
    """Markdown without fences, images, link targets, leading markers and back ticks."""
    for pattern, put in ((r"(?s)```.*?```", "\n"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^[>#*\-0-9.\s]+", ""), ("`", "")):
        text = F.regexp_replace(text, pattern, put)
    return _tidied(unescape(text))


def hits(lowered: Column, patterns: tuple[str, ...]) -> Column:
    """The patterns that a lower-case text contains, in their order."""
    return let(lowered, lambda low: F.filter(_quoted(patterns), lambda p: F.contains(low, p)))


def price_hits(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(f"price_{i}")) for i, p in enumerate(dims.PRICE, 1)]))


def ordered_distinct(values: Column, most: int | None = None) -> Column:
    """First of each value without regard to case, in order; empty values go."""
    return unique(values, most)


def product_tokens(*parts: Column) -> Column:
    """The first twelve different tokens of some texts."""
    return unique(F.regexp_extract_all(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit("([A-Za-z0-9][A-Za-z0-9.+-]{2,})"), F.lit(1)), 12)


def language_counts(text: Column) -> tuple[Column, Column]:
    """Hangul syllables and Latin letters."""
    return F.length(text) - F.length(F.regexp_replace(text, "[가-힣]", "")), F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
