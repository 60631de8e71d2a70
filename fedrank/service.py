"""Search as a service over a session: orchestration with a cache, HTTP, tool calls and a command line.

Sources are DataFrames of already fetched rows (see fedrank.sources); a live connector is any function that gives such rows
for a batch of queries.  All ranking is the same plan as in batch queries.
"""

from __future__ import annotations

import json
import sys
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .operators import settlement
from .plans import rules
from .sources import html

APP = {"name": "fedrank", "version": "0.1.0", "description": "Federated search ranking on Spark"}
#: queries -> (rows, settle times), as rank_results() and fast_path() take them
Fetch = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class BadRequest(ValueError):
    pass


def now_iso() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def validate(body: dict) -> dict:
    """A search request with its defaults; raises BadRequest."""
    query, limit, engines = body.get("query"), body.get("limit", 10), body.get("engines")
    if not isinstance(query, str) or not query:
        raise BadRequest("query is required")
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 20:
        raise BadRequest("limit must be an integer from 1 to 20")
    if engines is not None and (not isinstance(engines, list) or any(e not in rules.ENGINES for e in engines)):
        raise BadRequest("engines must be a list of known engines")
    return {"query": query, "limit": limit, "engines": engines, "verbose": bool(body.get("verbose", False))}


class ResultCache:
    """Entries by age and use, with one computation for each key at a time."""

    def __init__(self, ttl_ms: int, most: int, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl_ms / 1000, most, clock
        self.lock, self.entries, self.flying = threading.Lock(), OrderedDict(), {}
        self.counts = dict.fromkeys(("hits", "misses", "inflight_hits", "writes"), 0)

    @staticmethod
    def key(query: str, engines: list[str] | None, limit: int) -> str:
        return f"{query.strip().lower()}|{'all' if engines is None else ','.join(sorted(engines))}|{limit}"

    def _live(self, key: str) -> Any:
        found = self.entries.get(key)
        if found is None or self.clock() - found[0] > self.ttl:
            self.entries.pop(key, None)
            return None
        self.entries.move_to_end(key)
        return found[1]

    def put(self, key: str, value: Any) -> None:
        with self.lock:
            for k in [k for k, (t, _) in self.entries.items() if self.clock() - t > self.ttl]:
                del self.entries[k]
            self.entries.pop(key, None)
            self.entries[key] = (self.clock(), value)
            while len(self.entries) > self.most:
                self.entries.popitem(last=False)
            self.counts["writes"] += 1

    def get(self, key: str, make: Callable[[], Any]) -> tuple[Any, bool]:
        """The value, and whether it was cached.  Failures are not kept."""
        with self.lock:
            if (value := self._live(key)) is not None:
                self.counts["hits"] += 1
                return value, True
            self.counts["misses"] += 1
            if flight := self.flying.get(key):
                self.counts["inflight_hits"] += 1
            else:
                mine = self.flying[key] = {"done": threading.Event()}
        if flight:
            flight["done"].wait()
            if "error" in flight:
                raise flight["error"]
            return flight["value"], False
        try:
            mine["value"] = make()
            self.put(key, mine["value"])
            return mine["value"], False
        except Exception as e:
            mine["error"] = e
            raise
        finally:
            with self.lock:
                del self.flying[key]
            mine["done"].set()

    def stats(self) -> dict:
        with self.lock:
            return {"size": len(self.entries), "inflight": len(self.flying), "ttl_ms": int(self.ttl * 1000), "max_entries": self.most, **self.counts}


class Engine:
    """Searches and extractions, with counters."""

    def __init__(self, spark: SparkSession, fetch: Fetch, load_page: Callable[[str], str] | None = None, config: Config | None = None):
        self.spark, self.fetch, self.load_page, self.config = spark, fetch, load_page, config or Config.load()
        self.cache = ResultCache(self.config.cache_ttl_ms, self.config.cache_max)
        self.later: dict[str, dict] = {}
        self.runtime: dict[str, Any] = {"started_at": now_iso(), "requests": {"search": 0, "extract": 0, "health": 0}, "engine_failures": {}, "last_error": None}

    def run(self, query: str, limit: int = 10, engines: list[str] | None = None, await_background: bool = False) -> dict:
        """One search: the fast answer; the final one, where it differs, is kept for the cache under ``later``."""
        asked = self.spark.createDataFrame([(1, query, limit, engines)], "query_id long, query string, limit int, engines array<string>")
        serp, settled = self.fetch(asked)
        settled = settlement.apply_timeouts(settled, self.config.search_timeout_ms, self.config.api_timeout_ms)
        rows = settlement.answers(serp, settled, asked, await_background, self.config.enable_brave).collect()
        phases = {r.phase: self._answer(r) for r in rows}
        if "fast" in phases and "final" in phases:
            final = phases["final"]
            if len(final["engines"]["completed"]) > len(phases["fast"]["engines"]["completed"]) or len(final["engines"]["failed"]) != len(phases["fast"]["engines"]["failed"]):
                self.later[self.cache.key(query, engines, limit)] = final
        return phases.get("fast") or phases["final"]

    @staticmethod
    def _answer(row) -> dict:
        stats = row.stats.asDict()
        return {
            "results": [{k: r[k] for k in ("title", "url", "snippet", "score", "engines", "rank")} for r in row.results],
            "partial": row.partial, "engines": stats, "elapsed_ms": row.elapsed_ms, "intent": row.intent,
        }

    def search(self, body: dict) -> dict:
        """A search request's response."""
        asked = validate(body)
        self.runtime["requests"]["search"] += 1
        self.runtime |= {"last_search_at": now_iso(), "last_search_query": asked["query"]}
        began = time.monotonic()
        key = self.cache.key(asked["query"], asked["engines"], asked["limit"])
        answer, cached = self.cache.get(key, lambda: self.run(asked["query"], asked["limit"], asked["engines"]))
        if not cached and (final := self.later.pop(key, None)):
            self.cache.put(key, final)
        self.runtime["last_search_ms"] = round((time.monotonic() - began) * 1000)
        if not cached:
            for engine, error in answer["engines"]["errors"].items():
                self.runtime["engine_failures"][engine] = {"error": error, "at": now_iso()}
        out = {"query": asked["query"], "results": answer["results"], "total": len(answer["results"]), "intent": answer["intent"]}
        if asked["verbose"]:
            out |= {"elapsed_ms": answer["elapsed_ms"], "engines": answer["engines"]}
        if cached:
            out["cached"] = True
        return out | {"partial": answer["partial"], "meta": {"app": APP, "cache": self.cache.stats()}}

    def extract(self, url: str) -> dict:
        if not isinstance(url, str) or not url.startswith("http"):
            raise BadRequest("url is required")
        if self.load_page is None:
            raise RuntimeError("no page loader is configured")
        self.runtime["requests"]["extract"] += 1
        self.runtime |= {"last_extract_at": now_iso(), "last_extract_url": url}
        began = time.monotonic()
        title, content, words = html.extract(self.load_page(url), self.config.max_content_chars)
        self.runtime["last_extract_ms"] = round((time.monotonic() - began) * 1000)
        return {"url": url, "title": title, "content": content, "wordCount": words, "meta": {"app": APP}}

    def health(self) -> dict:
        self.runtime["requests"]["health"] += 1
        return {"status": "ok", "ready": True, "app": APP, "cache": self.cache.stats(), "runtime": self.runtime | {"config": self.config.public()}}

    def failed(self, scope: str, error: Exception) -> str:
        message = str(error).split("\n")[0]
        self.runtime["last_error"] = {"scope": scope, "message": message, "at": now_iso()}
        return message


def openapi(config: Config) -> dict:
    """The HTTP contract."""
    text = {"type": "string"}
    search = {
        "type": "object", "required": ["query"],
        "properties": {"query": text, "limit": {"type": "integer", "minimum": 1, "maximum": 20, "default": 10}, "engines": {"type": "array", "items": {"type": "string", "enum": list(rules.ENGINES)}}, "verbose": {"type": "boolean", "default": False}},
    }
    extract = {"type": "object", "required": ["url"], "properties": {"url": {"type": "string", "format": "uri"}}}
    body = lambda schema: {"required": True, "content": {"application/json": {"schema": schema}}}
    replies = lambda *codes: {c: {"description": d} for c, d in codes}
    bad = (("400", "Invalid request"), ("500", "Failure"))
    return {
        "openapi": "3.1.0",
        "info": {"title": APP["name"], "version": APP["version"], "description": APP["description"]},
        "servers": [{"url": f"http://{config.host}:{config.port}"}],
        "paths": {
            "/health": {"get": {"summary": "State", "responses": replies(("200", "State"))}},
            "/search": {"post": {"summary": "Search", "requestBody": body(search), "responses": replies(("200", "Results"), *bad)}},
            "/extract": {"post": {"summary": "Main text of a page", "requestBody": body(extract), "responses": replies(("200", "Text"), *bad)}},
            "/openapi.json": {"get": {"summary": "This contract", "responses": replies(("200", "Contract"))}},
        },
    }


ROUTES = ["GET /health", "GET /openapi.json", "POST /search", "POST /extract"]


def handle(engine: Engine, method: str, path: str, raw: str = "") -> tuple[int, dict]:
    """Status and body of an HTTP request.  A body that is no JSON counts as empty."""
    try:
        body = json.loads(raw or "{}")
    except ValueError:
        body = {}
    body = body if isinstance(body, dict) else {}
    route = f"{method} {urlsplit(path).path}"
    try:
        if route == "GET /health":
            return 200, engine.health()
        if route == "GET /openapi.json":
            return 200, openapi(engine.config)
        if route == "POST /search":
            return 200, engine.search(body)
        if route == "POST /extract":
            return 200, engine.extract(body.get("url"))
        return 404, {"error": "Not found", "routes": ROUTES}
    except BadRequest as e:
        return 400, {"error": str(e)}
    except Exception as e:
        message = engine.failed("http.request", e)
        return 500, {"error": f"Extract failed: {message}" if route == "POST /extract" else message}


def serve(engine: Engine) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, body = handle(engine, self.command, self.path, raw)
            data = json.dumps(body, indent=2, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args):
            print(*args, file=sys.stderr)

    return ThreadingHTTPServer((engine.config.host, engine.config.port), Handler)


def call_tool(engine: Engine, name: str, arguments: dict) -> dict:
    """A tool call's result, as text content: ``search``, ``extract`` or, if enabled, ``health``."""
    tools = {"search": lambda: engine.search(arguments), "extract": lambda: engine.extract(arguments.get("url"))}
    if engine.config.health_tool:
        tools["health"] = engine.health
    try:
        if name not in tools:
            raise BadRequest(f"unknown tool {name}")
        return {"content": [{"type": "text", "text": json.dumps(tools[name](), indent=2, ensure_ascii=False)}]}
    except Exception as e:
        message = engine.failed(f"tool.{name}", e)
        failure = {"query": arguments.get("query"), "results": [], "error": message} if name == "search" else {"error": message}
        return {"content": [{"type": "text", "text": json.dumps(failure, indent=2)}], "isError": True}


def parse_args(args: list[str]) -> dict:
    """``query… [--limit N|--limit=N] [--fields=a,b] [--verbose|-v]``"""
    out: dict[str, Any] = {"query": [], "limit": 10, "fields": None, "verbose": False}
    rest = list(args)
    while rest:
        a = rest.pop(0)
        if a in ("--verbose", "-v"):
            out["verbose"] = True
        elif a == "--limit" and rest:
            out["limit"] = int(rest.pop(0))
        elif a.startswith("--limit="):
            out["limit"] = int(a.split("=", 1)[1])
        elif a.startswith("--fields="):
            out["fields"] = a.split("=", 1)[1].split(",")
        elif not a.startswith("-"):
            out["query"].append(a)
    return out | {"query": " ".join(out["query"])}


def main(engine: Engine, args: list[str], out=sys.stdout) -> int:
    """``serve``, ``extract <url>``, or a search; one line of JSON."""
    if args[:1] == ["serve"]:
        serve(engine).serve_forever()
        return 0
    try:
        if args[:1] == ["extract"]:
            answer = engine.extract(args[1] if len(args) > 1 else "")
        else:
            asked = parse_args(args)
            answer = engine.search({k: asked[k] for k in ("query", "limit", "verbose")})
            if asked["fields"] is not None:
                answer["results"] = [{k: v for k, v in r.items() if k in asked["fields"]} for r in answer["results"]]
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    out.write(json.dumps(answer, ensure_ascii=False) + "\n")
    return 0


def json_lines(df: DataFrame, path: str) -> None:
    """Writes rows as lines of JSON."""
    df.write.mode("overwrite").json(path)
