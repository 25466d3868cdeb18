"""Pages over HTTP from a local server: profiles, error pages, timeouts, limits by host, side results."""

import contextlib
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from keyloom.sources import scan


class Handler(BaseHTTPRequestHandler):
    active, most, lock = 0, 0, threading.Lock()

    def do_GET(self):
        with Handler.lock:
            Handler.active += 1
            Handler.most = max(Handler.most, Handler.active)
        time.sleep(0.05)
        with Handler.lock:  # before the response: the next request follows it at once
            Handler.active -= 1
        with contextlib.suppress(BrokenPipeError):
            self.answer()

    def send(self, code, body, kind="text/html; charset=utf-8"):
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def answer(self):
        if self.path == "/gone":
            self.send(404, b"<html>not here</html>")
        elif self.path == "/bare":
            self.send(500, b"")
        elif self.path == "/picky" and "Chrome" in self.headers["User-Agent"]:
            self.connection.close()  # no response to browsers
        elif self.path == "/slow":
            time.sleep(3)
            self.send(200, b"late")
        elif self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/korean")
            self.end_headers()
        elif self.path == "/korean":
            self.send(200, "<html><title>보습 크림</title><body>레티놀</body></html>".encode("cp949"), "text/html; charset=cp949")
        elif self.path == "/empty":
            self.send(200, b"")
        else:
            self.send(200, f"<html><title>{self.path}</title></html>".encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


PATHS = ("/gone", "/bare", "/picky", "/slow", "/moved", "/korean", "/empty", "/a")


def check(pages, server):
    got = {r.raw_url.removeprefix(server): r for r in pages.collect()}
    assert set(got) == {*PATHS, "ftp://x/y", "http://127.0.0.1:1/nobody"}
    assert (got["/a"].html, got["/a"].http_status, got["/a"].fetch_profile, got["/a"].error) == ("<html><title>/a</title></html>", 200, "desktop_chrome", None)
    assert (got["/gone"].http_status, got["/gone"].html, got["/gone"].tries) == (404, "<html>not here</html>", 1)
    assert (got["/picky"].fetch_profile, got["/picky"].tries, got["/picky"].http_status) == ("generic_html", 2, 200)
    assert got["/moved"].final_url == server + "/korean" and "레티놀" in got["/moved"].html and got["/korean"].charset_selected == "cp949"
    for path in ("/bare", "/slow", "ftp://x/y", "http://127.0.0.1:1/nobody"):
        assert got[path].html is None and got[path].error.startswith("failed to fetch") and got[path].tries == 2, path
    assert got["/empty"].html is None and got["/empty"].error.endswith("empty html")


def test_named_pages(spark, server):
    urls = [server + p for p in PATHS] + ["ftp://x/y", "http://127.0.0.1:1/nobody", server + "/a"]
    check(scan.pages_of(scan.named_pages(spark, urls, timeout=1, per_host=2)), server)
    assert scan.named_pages(spark, []).count() == 0
    with pytest.raises(ValueError):
        scan.PageReader({"urls": str([*map(str, range(scan.MOST_NAMED + 1))]).replace("'", '"')})


def test_partitions_are_planned_by_host():
    r = scan.PageReader({"urls": '["http://a/1", "http://a/2", "http://a/3", "http://b/1", "http://A/4", "no url"]', "per_host": "2"})
    assert sorted((p.value, p.urls) for p in r.partitions()) == [("", ["no url"]), ("a", ["http://a/1", "http://a/3"]), ("a", ["http://a/2", "http://A/4"]), ("b", ["http://b/1"])]


def test_pages_of_a_table_keep_the_limit(spark, server):
    urls = spark.createDataFrame([(server + p,) for p in PATHS] * 2 + [("ftp://x/y",), ("http://127.0.0.1:1/nobody",), (None,)], "url string")
    check(scan.pages_of(scan.scan_pages(urls, timeout=1)), server)
    many = spark.createDataFrame([(f"{server}/page{i}",) for i in range(30)], "url string").repartition(6)
    for lanes in (1, 2):
        Handler.most = 0
        assert scan.scan_pages(many, per_host=lanes).where("http_status = 200").count() == 30
        assert 1 <= Handler.most <= lanes
    assert scan.scan_pages(many.limit(0)).count() == 0


def test_sidecars(spark, tmp_path):
    rows = [("u", "<p>x</p>", "# x", None), ("v", " ", None, "fit")]
    scan.write_sidecars(spark.createDataFrame(rows, "raw_url string, cleaned_html string, markdown string, fit_markdown string"), str(tmp_path / "s"))
    got = {r.raw_url: r for r in scan.read_sidecars(spark, str(tmp_path / "s")).collect()}
    assert (got["u"].cleaned_html, got["u"].markdown, got["u"].fit_markdown, got["u"].fit_html) == ("<p>x</p>", "# x", None, None) and got["v"].fit_markdown == "fit" and got["v"].cleaned_html is None
