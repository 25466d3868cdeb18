"""Pages over HTTP as a Spark source, planned by host, and the side results of rendered pages as tables.

``spark.read.format("pages")`` reads the urls named in its options: every host gets at most ``per_host`` partitions, which are
that many connections at once, and a pause between two requests of a connection. For urls in a table, ``scan_pages`` deals rows by host in the same way, so no url
passes through the driver. A page is asked for under one header profile after the other; the first response counts, an
error page with a body too. What nobody answers is a row with an error.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keyloom.functions import structured, web
from keyloom.workers import findable, ready

SCAN = "raw_url string, final_url string, http_status int, content_type string, fetch_profile string, headers map<string,string>, body binary, error string, tries int"
#: Request headers in the order in which they are tried (names and browser string are fixed values).
PROFILES: tuple[tuple[str, dict[str, str]], ...] = (
    ("desktop_chrome", {"Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", "Accept-Language": "ko-KR,ko;q=0.9,en;q=0.7", "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/135.0.0.0 Safari/537.36"}),
    ("generic_html", {"Accept": "text/html,*/*;q=0.8", "Accept-Language": "ko,en;q=0.8", "User-Agent": "keyloom/1.0"}),
)
TIMEOUT, PER_HOST, PAUSE = 15.0, 2, 0.0
#: Urls that options may name; more belong into a table.
MOST_NAMED = 10_000

#: From url, headers and timeout to final_url, http_status, headers and body; raises if there is no response.
Opener = Callable[[str, dict[str, str], float], dict]


def http_open(url: str, headers: dict[str, str], timeout: float) -> dict:
    """One request. A response with an error status is a response if it has a body."""
    if urlsplit(url).scheme.lower() not in ("http", "https"):
        raise ValueError(f"not a web address: {url}")
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return {"final_url": r.geturl(), "http_status": r.status, "headers": dict(r.headers.items()), "body": r.read()}
    except urllib.error.HTTPError as error:
        body = error.read()
        if not body:
            raise
        return {"final_url": error.geturl(), "http_status": error.code, "headers": dict(error.headers.items()), "body": body}


def scan_one(url: str, open_url: Opener, profiles: Sequence[tuple[str, dict[str, str]]] = PROFILES, timeout: float = TIMEOUT) -> tuple:
    """The row (SCAN) of one url."""
    error = "no profile"
    for tries, (profile, headers) in enumerate(profiles, 1):
        try:
            got = open_url(url, headers, timeout)
        except Exception as e:  # noqa: BLE001 - the next profile may get it
            error = f"{type(e).__name__}: {e}"
            continue
        heads = {str(k): str(v) for k, v in (got.get("headers") or {}).items()}
        kind = next((v for k, v in heads.items() if k.lower() == "content-type"), "text/html")
        return (url, got.get("final_url") or url, int(got.get("http_status") or 200), kind, profile, heads, got.get("body") or b"", None, tries)
    return (url, None, None, None, None, None, None, f"failed to fetch {url}: {error}", len(profiles))


def _host(url: str) -> str:
    try:
        return (urlsplit(url).netloc.rpartition("@")[2]).lower()
    except ValueError:
        return ""


def _opener(name: str) -> Opener:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class HostPart(InputPartition):
    """Urls of one host that one connection asks for, one after the other."""

    def __init__(self, host: str, urls: list[str]):
        super().__init__(host)
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = list(dict.fromkeys(json.loads(options.get("urls", "[]"))))
        if len(self.urls) > MOST_NAMED:
            raise ValueError(f"{len(self.urls)} urls in options; read more than {MOST_NAMED} from a table with scan_pages")
        self.opener, self.timeout = options.get("opener", "keyloom.sources.scan:http_open"), float(options.get("timeout", TIMEOUT))
        self.per_host, self.pause = max(1, int(options.get("per_host", options.get("perhost", PER_HOST)))), float(options.get("pause", PAUSE))

    def partitions(self) -> list[HostPart]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(_host(u), []).append(u)
        return [HostPart(h, own[i :: self.per_host]) for h, own in hosts.items() for i in range(min(self.per_host, len(own)))]

    def read(self, part: HostPart) -> Iterator[tuple]:
        if part is None:
            return
        open_url = _opener(self.opener)
        for i, u in enumerate(part.urls):
            if i:
                time.sleep(self.pause)
            yield scan_one(u, open_url, timeout=self.timeout)


class Pages(DataSource):
    """``pages``: rows (SCAN) of the urls in the option ``urls`` (a JSON list). Options: opener (module:function), timeout, per_host, pause."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema: object) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    findable(spark)
    spark.dataSource.register(Pages)


def named_pages(spark: SparkSession, urls: list[str], **options: object) -> DataFrame:
    """The rows (SCAN) of a few urls, each once."""
    register(spark)
    return spark.read.format("pages").options(urls=json.dumps(urls), **{k: str(v) for k, v in options.items()}).load()


def scan_pages(urls: DataFrame, url_col: str = "url", open_url: Opener = http_open, per_host: int = PER_HOST, pause: float = PAUSE, timeout: float = TIMEOUT, profiles: Sequence[tuple[str, dict[str, str]]] = PROFILES) -> DataFrame:
    """The rows (SCAN) of a table's distinct urls. All rows of (host, lane) lie in one partition, in order, so a host meets at most ``per_host`` requests at once."""
    schema = pa.schema([("raw_url", pa.string()), ("final_url", pa.string()), ("http_status", pa.int32()), ("content_type", pa.string()), ("fetch_profile", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("error", pa.string()), ("tries", pa.int32())])
    asked = ready(urls).select(F.col(f"`{url_col}`").alias("raw_url")).where("raw_url is not null").distinct()
    lane = F.pmod(F.xxhash64("raw_url"), F.lit(per_host))
    dealt = asked.withColumns({"host_": host_of(F.col("raw_url")), "lane_": lane}).repartition("host_", "lane_").sortWithinPartitions("host_", "lane_", "raw_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for url, host in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if host == last:
                    time.sleep(pause)
                last = host
                row = scan_one(url, open_url, profiles, timeout)
                cols = [[v] if n != "headers" else [None if v is None else list(v.items())] for n, v in zip(schema.names, row, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)  # a page may be long: one a batch

    return dealt.mapInArrow(run, SCAN)


def host_of(url: Column) -> Column:
    return F.coalesce(web.host(url), F.lit(""))


def pages_of(scanned: DataFrame) -> DataFrame:
    """Scanned rows with their text: charset, its confidence and signs of damage; an empty body is an error."""
    body = structured.decode_body(F.col("body"), F.col("content_type"))
    out = ready(scanned).withColumn("d_", body)
    text = F.nullif(F.col("d_.text"), F.lit(""))
    error = F.coalesce("error", F.when(text.isNull(), F.concat(F.lit("failed to fetch "), "raw_url", F.lit(": empty html"))))
    return out.select("raw_url", "final_url", text.alias("html"), "http_status", "content_type", "fetch_profile", F.col("d_.charset").alias("charset_selected"), F.col("d_.confidence").alias("charset_confidence"), F.col("d_.flags").alias("mojibake_flags"), "headers", "tries", error.alias("error"))


#: Side results of a rendered page, one table each.
SIDECARS = ("cleaned_html", "markdown", "fit_markdown", "fit_html")


def write_sidecars(rendered: DataFrame, folder: str) -> None:
    """The side results that rendered pages (raw_url, SIDECARS as far as there are any, screenshot) have, one row each, in a partition by kind."""
    kinds = [c for c in SIDECARS if c in rendered.columns]
    each = F.array(*[F.struct(F.lit(c).alias("kind"), F.nullif(F.trim(c), F.lit("")).alias("content")) for c in kinds])
    rows = rendered.select("raw_url", F.explode(each).alias("s")).select("raw_url", "s.kind", "s.content").where("content is not null")
    rows.withColumn("chars", F.length("content").cast("long")).write.mode("overwrite").partitionBy("kind").parquet(folder)


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Side results as columns beside the url, one row a page; a kind that was never written is null."""
    rows = spark.read.schema("raw_url string, content string, chars long, kind string").parquet(folder)
    return rows.groupBy("raw_url").pivot("kind", list(SIDECARS)).agg(F.max("content"))
