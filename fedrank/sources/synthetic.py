"""Searches, responses and settle times derived from the table ``pages``, so that every rule has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import rules

QUERIES = (
    "nodejs documentation", "typescript handbook", "rust async runtime", "large language model", "reddit api docs", "python vs. rust", "github api",
    "what is entropy", "history of python library", "example code for the web", "ollama local llm", "guide to the example blog",
)
#: Hosts that pages get by their number, so that each rule about hosts applies to some.
HOSTS = ("docs.rs", "github.com", "www.reddit.com", "en.wikipedia.org", "medium.com", "docs.python.org", "nodejs.org", "pkg.go.dev", "blog.example.org", "api.ollama.com", "shop.example.com", "dev.to")
PATHS = ("/docs/start", "/issues/7", "/r/search", "/wiki/page", "/", "/reference", "/api/v1", "/blog/post", "/guide", "/releases", "/pull/3", "/tutorials/one")
#: A search has the pages of three neighbouring groups of eight, and a page is in three searches: all pages are dealt, and the
#: number of searches grows with the table.
GROUP, SPAN, HARVEST = 8, 3, rules.HARVEST


def dealt(pages: DataFrame) -> DataFrame:
    """``query_id, r, page_id``: the searches of each page and its place in them."""
    cells = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(SPAN - 1))).alias("k"))
    return cells.select((F.floor(F.col("page_id") / GROUP) + F.col("k") + 1).cast("bigint").alias("query_id"), (F.pmod("page_id", F.lit(GROUP)) + GROUP * F.col("k")).alias("r"), "page_id")


def queries(pages: DataFrame) -> DataFrame:
    """``query_id, query, limit`` of the searches; texts repeat."""
    texts = F.array(*map(F.lit, QUERIES))
    ids = dealt(pages).select("query_id").distinct()
    return ids.select("query_id", F.get(texts, ((F.col("query_id") - 1) % len(QUERIES)).cast("int")).alias("query"), F.lit(10).alias("limit"))


def hits(pages: DataFrame) -> DataFrame:
    """``query_id, engine, arrival_ms, pos, title, url, snippet``."""
    q, r, e = F.col("query_id"), F.col("r"), F.col("e")
    cells = dealt(pages).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(len(rules.ENGINES) - 1))))
    cells = cells.where(((r + e * 3 + q) % 7 < 1 + r % 6) & ((q + e) % 7 != 0))
    w = payload_window()
    cells = cells.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < HARVEST)
    rows = cells.join(pages.select("page_id", "url", "html"), "page_id")
    host = F.get(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % len(HOSTS)).cast("int"))
    path = F.get(F.array(*map(F.lit, PATHS)), ((F.col("page_id") / 3).cast("bigint") % len(PATHS)).cast("int"))
    url = F.concat(F.lit("https://"), host, path, F.when(path == "/", "").otherwise(F.concat(F.lit("/p"), F.col("page_id").cast("string"))))
    url = F.concat(url, F.when(e % 3 == 1, "/").otherwise(""), F.when(e % 2 == 1, "?utm_medium=x").otherwise(""))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    snippet = F.substr(F.regexp_extract("html", "<p>([^<]*)<", 1), F.lit(1), (80 + 20 * e).cast("int"))
    engine = F.get(F.array(*map(F.lit, rules.ENGINES)), e)
    return rows.select("query_id", engine.alias("engine"), ((q * 389 + e * 613) % 5000).cast("int").alias("arrival_ms"), "pos", title.alias("title"), url.alias("url"), snippet.alias("snippet"))


def payload_window():
    from pyspark.sql import Window as W

    return W.partitionBy("query_id", "e").orderBy((F.col("r") * 11 + F.col("e") * 5) % 29, "r")


def settlements(queries: DataFrame) -> DataFrame:
    """``query_id, engine, arrival_ms, ok, error``: one engine of each search fails."""
    q, e = F.col("query_id"), F.col("e")
    cells = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(len(rules.ENGINES) - 1))).alias("e"))
    ok = (q + e) % 7 != 0
    return cells.select("query_id", F.get(F.array(*map(F.lit, rules.ENGINES)), e).alias("engine"), ((q * 389 + e * 613) % 5000).cast("int").alias("arrival_ms"), ok.alias("ok"), F.when(~ok, "HTTP 503").alias("error"))
