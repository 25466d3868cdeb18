"""Pages over the network through injected fetchers: the first that answers wins, and an error page is an answer too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from keyloom.workers import ready

#: What a fetch gives; the last four only if the page was rendered.
PAGE = "raw_url string, final_url string, html string, http_status int, content_type string, fetch_profile string, error string, cleaned_html string, markdown string, fit_markdown string, screenshot boolean"
_FIELDS = [f.split(" ")[0] for f in PAGE.split(", ")]


def fetch_one(url: str, fetchers: list[tuple[str, Callable[[str], dict]]]) -> dict:
    """The first answer with a page; else the last error."""
    error = "no fetcher"
    for profile, fetch in fetchers:
        try:
            got = fetch(url)
        except Exception as e:  # noqa: BLE001 - the next profile may get it
            error = f"{type(e).__name__}: {e}"
            continue
        if got.get("html"):
            return {"raw_url": url, "final_url": got.get("final_url") or url, "http_status": got.get("http_status") or 200, "content_type": got.get("content_type") or "text/html", "fetch_profile": profile, "error": None} | {k: got.get(k) for k in ("html", "cleaned_html", "markdown", "fit_markdown", "screenshot")}
        error = "empty html"
    return {"raw_url": url, "error": error}


def fetch_pages(urls: DataFrame, fetchers: list[tuple[str, Callable[[str], dict]]], url_col: str = "url") -> DataFrame:
    """One row (PAGE) for each url. Fetchers take a url and give a dict with html and, if they know, the other fields; they must be serialisable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([fetch_one(u, fetchers) for u in b[url_col]], columns=_FIELDS).astype(object).where(lambda x: x.notna(), None)

    return ready(urls).select(url_col).mapInPandas(run, PAGE)
