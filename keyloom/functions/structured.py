"""JSON-LD of pages, character sets, and normal forms that Spark lacks."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

_SCRIPT = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_URL = re.compile(r"https?://|www\.|\.html(?:\b|$)")


def json_ld(page: Column) -> Column:
    """The parsable JSON-LD scripts of a page as an array of VARIANT."""
    return F.filter(F.transform(json_ld_texts(page), lambda x: F.try_parse_json(F.trim(x))), lambda v: v.isNotNull())


def json_ld_texts(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(_SCRIPT), F.lit(1))


def walk(value: object) -> Iterator[dict]:
    """The objects of a JSON value from the top: lists and ``@graph`` are flattened, in order."""
    pending = [value]
    while pending:
        now = pending.pop()
        if isinstance(now, list):
            pending.extend(reversed(now))
        elif isinstance(now, dict):
            graph = now.get("@graph")
            pending.extend(reversed(graph) if isinstance(graph, list) else [])
            yield now


def _kinds(node: dict) -> list[str]:
    kind = node.get("@type")
    return [str(k) for k in kind] if isinstance(kind, list) else [] if kind is None else [str(kind)]


def _words(value: object) -> str:
    return " ".join(str(value or "").split())


def _name(value: object) -> str:
    """A text, or the name of an object."""
    return _words(value.get("name")) if isinstance(value, dict) else _words(value) if isinstance(value, str) else ""


def _first(values: Iterator[str]) -> str | None:
    return next((v for v in values if v), None)


def _plain(value: object) -> str | None:
    return None if value is None else str(value).strip() or None


def price_digits(value: object) -> str | None:
    digits = re.sub("[^0-9]", "", "" if value is None else str(value))
    return digits if 4 <= len(digits) <= 6 else None


def product_signals(nodes: list[dict]) -> dict:
    """What a page's snapshot takes from JSON-LD objects: nodes of the type ``Product``, as it is spelt."""
    own = [n for n in nodes if "Product" in _kinds(n)]
    brands = (b.get("name") if isinstance(b, dict) else b for b in (n.get("brand") for n in own) if b)
    return {"has_product": bool(own), "name": _first(_plain(n.get("name")) for n in own), "description": _first(_plain(n.get("description")) for n in own), "brand": _first(map(_plain, brands))}


def product_facts(nodes: list[dict]) -> dict:
    """What evidence takes from JSON-LD objects: products in any spelling, and the last name of a breadcrumb."""
    kinds = [{k.casefold() for k in _kinds(n)} for n in nodes]
    own = [n for n, k in zip(nodes, kinds, strict=True) if "product" in k]
    crumbs = [n.get("itemListElement") for n, k in zip(nodes, kinds, strict=True) if "breadcrumblist" in k]
    brands = (" ".join(re.sub(r"\s*\([^)]*\)\s*", " ", _name(n.get(k))).split()) for n in own for k in ("brand", "manufacturer"))
    category = _first(c for c in (_words(n.get("category")) for n in own) if not _URL.search(c.casefold()))
    for entries in crumbs if category is None else []:
        names = [_name(e.get("item")) or _words(e.get("name")) for e in (entries if isinstance(entries, list) else []) if isinstance(e, dict)]
        names = [n for n in names if n and not _URL.search(n.casefold())]
        if names:
            category = names[-1]
            break
    offers = (o for n in own for o in (n.get("offers") if isinstance(n.get("offers"), list) else [n.get("offers")]) if isinstance(o, dict))
    texts = {}
    for n in own:
        texts.setdefault(_words(n.get("description")).casefold(), _words(n.get("description")))
    return {"fact_name": _first(_words(n.get("name")) for n in own), "fact_brand": _first(brands), "fact_category": category, "fact_price": _first(price_digits(o.get("price")) for o in offers), "fact_descriptions": [t for t in texts.values() if t]}


SIGNALS = StructType(
    [StructField("payloads", IntegerType()), StructField("has_product", BooleanType())]
    + [StructField(n, StringType()) for n in ("name", "description", "brand", "fact_name", "fact_brand", "fact_category", "fact_price")]
    + [StructField("fact_descriptions", ArrayType(StringType()))]
)


def page_signals(texts: list[str] | None) -> dict:
    """Signals of a page's JSON-LD scripts; those that do not parse are passed over."""
    payloads = []
    for t in texts if texts is not None else []:
        try:
            payloads.append(json.loads(t.strip()))
        except (ValueError, RecursionError):
            continue
    nodes = list(walk(payloads))
    return {"payloads": len(payloads)} | product_signals(nodes) | product_facts(nodes)


@F.pandas_udf(SIGNALS)
def structured_signals(scripts: pd.Series) -> pd.DataFrame:
    """Signals of arrays of JSON-LD texts: objects of any depth, so Python walks them; only the scripts reach it, not the page."""
    return pd.DataFrame([page_signals(t) for t in scripts], columns=SIGNALS.names)


def resolved_title(raw: Column, og: Column, structured: Column) -> Column:
    """The raw title unless it is generic (two tokens at most, no digit); then og, JSON-LD, and last the raw one."""
    toks = F.size(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"([A-Za-z0-9ㄱ-힝][A-Za-z0-9ㄱ-힝.+&-]*)"), F.lit(1)))
    low = F.lower(F.coalesce(raw, F.lit("")))
    blocked = F.lit(False)
    for p in ("waiting room", "captcha", "forbidden", "access denied"):
        blocked = blocked | F.contains(low, F.lit(p))
    generic = F.when(toks == 0, True).when(blocked, False).when(raw.rlike("[0-9]"), False).otherwise(toks <= 2)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.when(some(raw).isNotNull() & ~generic, raw).otherwise(F.coalesce(some(og), some(structured), some(raw)))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


_READABLE = re.compile(r"[\w\s<>/=:;,.!?\"'()\-\u00C0-\u024F\u3131-\uD79D]+")
_META = re.compile(r"<meta[^>]+charset=[\"']?([A-Za-z0-9._-]+)", re.IGNORECASE | re.DOTALL)
_HEADER = re.compile(r"charset=([A-Za-z0-9._-]+)", re.IGNORECASE)


def damage(text: str) -> list[str]:
    """Signs that a text was decoded wrongly."""
    return ["replacement_characters"] * ("\ufffd" in text) + ["utf8_latin1_mojibake"] * any(m in text for m in "ÃÂðìë")


def decoded(body: bytes, content_type: str | None) -> tuple[str, str, float, list[str]]:
    """Text, charset, confidence and flags of a body: of the charsets that decode it strictly the one whose text scores best, ties to the first."""
    header, meta = _HEADER.search(content_type or ""), _META.search(body[:4096].decode("latin-1"))
    names = [m[1] for m in (header, meta) if m] + ["utf-8", "cp949", "euc-kr", "iso-8859-1"]
    best: tuple[float, str, str, list[str]] | None = None
    for i, name in enumerate(dict.fromkeys(n.lower() for n in names)):
        try:
            text = body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
        flags, low = damage(text), text.lower()
        marks = sum(low.count(m) for m in ("<html", "</title>", "<body"))
        score = sum(m.end() - m.start() for m in _READABLE.finditer(text)) / len(text) + min(marks * 0.08, 0.24) - 0.15 * len(flags) if text else 0.0
        score += 0.15 if i == 0 else 0
        if best is None or score > best[0]:
            best = (score, text, name, flags)
    if best is None:
        text = body.decode("utf-8", "replace")
        return text, "utf-8", 0.2, damage(text) or ["replacement_characters"]
    return best[1], best[2], round(min(max(best[0], 0.2), 1.0), 4), best[3]


# rows go to the worker a hundred at a time: whole bodies and their texts in batches of 10,000 would fill its memory
@F.udf(StructType([StructField("text", StringType()), StructField("charset", StringType()), StructField("confidence", DoubleType()), StructField("flags", ArrayType(StringType()))]), useArrow=False)
def decode_body(body: bytes | None, content_type: str | None) -> tuple:
    return decoded(bytes(body), content_type) if body is not None else (None, None, None, None)
