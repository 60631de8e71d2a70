"""Fetching pages and JSON over HTTP, for a live connector.  Nothing else in the library opens a connection."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from . import html, payloads

AGENT = "fedrank/0.1"
#: Where each engine is asked.
HOSTS = {
    "ddg": "https://html.duckduckgo.com",
    "bing": "https://www.bing.com",
    "google": "https://www.google.com",
    "brave": "https://search.brave.com",
    "reddit": "https://www.reddit.com",
    "github": "https://api.github.com",
    "wikipedia": "https://en.wikipedia.org",
}


def fetch_text(url: str, timeout_ms: int = 8000) -> str:
    """The response's text; raises with the status where it is none of success."""
    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout_ms / 1000) as response:
            return response.read().decode("utf-8", "replace")
    except HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}") from e


def fetch_json(url: str, timeout_ms: int = 8000):
    return json.loads(fetch_text(url, timeout_ms))


def request_url(engine: str, query: Column, limit: int = 10) -> Column:
    """The address that an engine's search asks, with as many rows as its request size allows."""
    n = str(payloads.request_size(engine, limit))
    path, params = {
        "ddg": ("/html/", {}),
        "bing": ("/search", {"count": n}),
        "google": ("/search", {"num": n}),
        "brave": ("/search", {"source": "web"}),
        "reddit": ("/search.json", {"limit": n, "type": "link"}),
        "github": ("/search/repositories", {"per_page": n}),
    }[engine]
    return urls.search_url(HOSTS[engine] + path, query, **params)


def wikipedia_url(limit: int, parameter: str, value: Column) -> Column:
    """The first request of a search (``srsearch``), or the second, for the pages that the first one found (``pageids``)."""
    n = payloads.request_size("wikipedia", limit)
    fixed = f"list=search&srlimit={n}" if parameter == "srsearch" else "prop=extracts%7Cinfo&exintro=true&explaintext=true&exlimit=max&inprop=url"
    return F.concat(F.lit(f"{HOSTS['wikipedia']}/w/api.php?action=query&format=json&{fixed}&{parameter}="), value)


def scan(queries: DataFrame, engine: str, limit: int = 10, timeout_ms: int = 8000, at_once: int = 2) -> DataFrame:
    """Rows of one engine for ``query_id, query``: requests, responses, rows.  Searches whose request fails have none; fetch_all() has the errors.

    The responses are kept for the time of the job (persist), so that a plan which uses them twice asks once.
    """
    asked = queries.select("query_id", "query")
    if engine == "wikipedia":
        found = fetch_all(asked.withColumn("url", wikipedia_url(limit, "srsearch", F.url_encode("query"))), timeout_ms, at_once).where("payload IS NOT NULL").select("query_id", "query", "payload").persist()
        ids = F.transform(F.from_json("payload", payloads.WIKI_SEARCH)["query"]["search"], lambda x: x["pageid"].cast("string"))
        extracts = fetch_all(found.select("query_id", "query", wikipedia_url(limit, "pageids", F.array_join(ids, "%7C")).alias("url")), timeout_ms, at_once).where("payload IS NOT NULL")
        return payloads.from_wikipedia(found, extracts.select("query_id", "query", "payload"), limit)
    got = fetch_all(asked.withColumn("url", request_url(engine, F.col("query"), limit)), timeout_ms, at_once).where("payload IS NOT NULL")
    if engine in ("reddit", "github"):
        return {"reddit": payloads.from_reddit, "github": payloads.from_github}[engine](got, limit)
    return html.from_search_pages(got.select("query_id", "query", F.col("payload").alias("html")), engine, limit)


def fetch_all(requests: DataFrame, timeout_ms: int = 8000, at_once: int = 2) -> DataFrame:
    """``query_id, query, url`` with ``payload, error`` added.  ``at_once`` partitions fetch, each one request at a time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", payload string, error string"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            payloads, errors = [], []
            for url in frame["url"]:
                try:
                    payloads.append(fetch_text(url, timeout_ms))
                    errors.append(None)
                except Exception as e:
                    payloads.append(None)
                    errors.append(str(e))
            yield frame.assign(payload=payloads, error=errors)

    return requests.repartition(at_once).mapInPandas(run, schema)
