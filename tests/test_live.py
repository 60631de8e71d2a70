"""Live scans against a server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from fedrank.sources import live

SEEN = []


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        parts = urlsplit(self.path)
        asked = parse_qs(parts.query)
        SEEN.append(self.path)
        if asked.get("q") == ["bad"]:
            return self.send_error(503)
        body = {
            "/search/repositories": {"items": [{"html_url": "https://github.com/a/b", "full_name": "a/b", "stargazers_count": 1}]},
            "/search.json": {"data": {"children": [{"data": {"url": "https://ex.com/", "permalink": "/r/x/1", "title": "T", "subreddit": "x", "score": 2}}]}},
        }.get(parts.path, {"query": {"pages": {"7": {"title": "Seven", "extract": "text"}}} if "pageids" in asked else {"search": [{"pageid": 7, "title": "Seven"}]}})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b'<li class="b_algo"><h2><a href="https://ex.com/1">One</a></h2></li>' if parts.path == "/search" else json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def home():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("engine, url", [("github", "https://github.com/a/b"), ("reddit", "https://ex.com/"), ("wikipedia", "https://en.wikipedia.org/wiki/Seven"), ("bing", "https://ex.com/1")])
def test_scan(spark, home, engine, url, monkeypatch):
    monkeypatch.setattr(live, "HOSTS", {k: home for k in live.HOSTS})
    queries = spark.createDataFrame([(1, "rust api"), (2, "bad")], "query_id long, query string")
    rows = live.scan(queries.where("query_id = 1"), engine).collect()
    assert [(r.query_id, r.pos, r.url, r.engine) for r in rows] == [(1, 0, url, engine)]
    if engine == "github":
        assert live.scan(queries, engine).count() == 1


def test_errors(spark, home):
    asked = spark.createDataFrame([(1, "q", home + "/search?q=bad"), (2, "q", home + "/search?q=x"), (3, "q", "http://127.0.0.1:9/")], "query_id long, query string, url string")
    rows = {r.query_id: r for r in live.fetch_all(asked, 500).select("query_id", F.col("payload").isNull().alias("no"), "error").collect()}
    assert (rows[1].no, rows[1].error) == (True, "HTTP 503") and (rows[2].no, rows[2].error) == (False, None) and rows[3].no and rows[3].error
