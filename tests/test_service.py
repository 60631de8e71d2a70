import io
import json

import pytest

from fedrank import service
from fedrank.config import Config, read_bool, read_int
from fedrank.sources import synthetic


@pytest.fixture(scope="module")
def engine(spark):
    calls = []

    def fetch(asked):
        calls.append(1)
        row = asked.collect()[0]
        if row["query"] == "boom":
            raise RuntimeError("down\nmore")
        serp = spark.createDataFrame(
            [(1, "ddg", 100, 0, "Node docs", "https://nodejs.org/docs", "official"), (1, "google", 4900, 0, "Late", "https://late.example.org/", "x")],
            "query_id long, engine string, arrival_ms int, pos int, title string, url string, snippet string",
        )
        rows = [(1, "ddg", 100, True, None), (1, "bing", 200, False, "HTTP 500"), (1, "google", 4900, True, None), (1, "github", 9000, True, None)]
        return serp, spark.createDataFrame(rows, "query_id long, engine string, arrival_ms int, ok boolean, error string")

    out = service.Engine(spark, fetch, lambda url: "<title>T</title><main>some words</main>", Config(brave_api_key="secret"))
    out.calls = calls
    return out


def post(engine, path, body):
    return service.handle(engine, "POST", path, body if isinstance(body, str) else json.dumps(body))


def test_search_and_cache(engine):
    status, first = post(engine, "/search", {"query": "nodejs documentation", "verbose": True})
    assert status == 200 and first["results"][0]["url"] == "https://nodejs.org/docs" and first["partial"] and first["intent"] == "docs"
    assert first["engines"]["failed"] == ["bing"] and "cached" not in first
    status, again = post(engine, "/search", {"query": " NODEJS documentation"})
    assert again["cached"] and again["total"] == 2 and len(engine.calls) == 1  # the final answer has replaced the fast one
    assert engine.runtime["engine_failures"]["bing"]["error"] == "HTTP 500"


def test_bad_requests(engine):
    assert post(engine, "/search", "no json")[0] == 400 and post(engine, "/search", {"query": "x", "limit": 99})[0] == 400
    assert post(engine, "/extract", {})[0] == 400 and service.handle(engine, "GET", "/no")[0] == 404
    assert post(engine, "/search", {"query": "boom"}) == (500, {"error": "down"})
    assert post(engine, "/search", {"query": "boom"})[0] == 500  # failures are not cached


def test_other_surfaces(engine):
    assert post(engine, "/extract", {"url": "https://a.b"})[1]["wordCount"] == 2
    status, health = service.handle(engine, "GET", "/health")
    assert status == 200 and health["runtime"]["config"]["brave_api_key"] == "***" and "secret" not in json.dumps(health)
    assert set(service.handle(engine, "GET", "/openapi.json")[1]["paths"]) == {"/health", "/search", "/extract", "/openapi.json"}
    tool = service.call_tool(engine, "search", {"query": "nodejs documentation"})
    assert json.loads(tool["content"][0]["text"])["cached"] and service.call_tool(engine, "search", {})["isError"] and service.call_tool(engine, "nothing", {})["isError"]
    out = io.StringIO()
    assert service.main(engine, ["nodejs", "documentation", "--fields=url,rank", "--limit", "10"], out) == 0
    assert set(json.loads(out.getvalue())["results"][0]) == {"url", "rank"}
    assert service.main(engine, ["extract", "nothing"], out) == 1
    assert service.parse_args(["a", "b", "--limit=3", "-v"]) == {"query": "a b", "limit": 3, "fields": None, "verbose": True}


def test_cache_limits():
    now = [0.0]
    cache = service.ResultCache(1000, 2, lambda: now[0])
    for k in "abc":
        assert cache.get(k, lambda k=k: k.upper()) == (k.upper(), False)
    assert cache.get("a", lambda: 1) == (1, False) and cache.get("c", lambda: 2) == ("C", True)
    now[0] = 2
    assert cache.get("c", lambda: 3) == (3, False) and cache.stats()["size"] == 1


def test_settings():
    env = {"A": "12px", "B": "x", "C": "ON", "D": "maybe"}
    assert read_int("A", 1, env=env) == 12 and read_int("A", 1, 20, env=env) == 1 and read_int("B", 5, env=env) == 5
    assert read_bool("C", False, env) and read_bool("D", True, env)
    assert Config.load({"FEDRANK_PORT": "70000", "FEDRANK_CACHE_MAX": "9"}).port == 3847


def test_synthetic_shapes(spark):
    pages = spark.createDataFrame([(i, f"https://a{i}.example.com/", "<title>t</title><p>p</p>") for i in range(20)], "page_id long, url string, html string")
    asked = synthetic.queries(pages)
    assert sorted(r.query_id for r in asked.collect()) == [1, 2, 3, 4, 5]
    dealt = synthetic.dealt(pages)
    assert dealt.count() == dealt.select("query_id", "r").distinct().count() == 60
    assert synthetic.hits(pages).count() > 100 and synthetic.settlements(asked).count() == 35
