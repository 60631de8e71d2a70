"""Search responses in JSON as rows.  Input: ``query_id, query, payload`` and, for some, ``status``; schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls
from ..operators import merge
from ..plans import rules

REDDIT = "STRUCT<data: STRUCT<children: ARRAY<STRUCT<data: STRUCT<url: STRING, permalink: STRING, is_self: BOOLEAN, title: STRING, selftext: STRING, subreddit: STRING, score: BIGINT>>>>>"
GITHUB = "STRUCT<items: ARRAY<STRUCT<html_url: STRING, full_name: STRING, name: STRING, description: STRING, topics: ARRAY<STRING>, stargazers_count: BIGINT, fork: BOOLEAN>>>"
WIKI_SEARCH = "STRUCT<query: STRUCT<search: ARRAY<STRUCT<pageid: BIGINT, title: STRING>>>>"
WIKI_PAGES = "STRUCT<query: STRUCT<pages: MAP<STRING, STRUCT<title: STRING, extract: STRING, fullurl: STRING, missing: STRING>>>>"
BRAVE = "STRUCT<web: STRUCT<results: ARRAY<STRUCT<title: STRING, url: STRING, description: STRING>>>>"
REDDIT_HOME = "https://www.reddit.com"
WIKI_HOME = "https://en.wikipedia.org/wiki/"


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _first_filled(*parts: Column) -> Column:
    return F.coalesce(*T.filled(*parts), F.lit(""))


def _scored(rows: DataFrame, engine: str, extra: Column | None = None) -> DataFrame:
    """Positions anew from 0, with score, domain and engine."""
    u = urls.parse(F.col("url"))
    score = S.base_score(T.keyword_tokens(F.col("query")), u, F.col("title"), F.col("snippet"))
    score = score if extra is None else score + extra
    pos = F.row_number().over(merge.W.partitionBy("query_id").orderBy("pos")) - 1
    return rows.select("query_id", pos.alias("pos"), "title", "url", "snippet", score.alias("score"), u["domain"].alias("domain"), F.lit(engine).alias("engine"))


def _cut(rows: DataFrame, limit: int) -> DataFrame:
    return merge.per_engine_limit(rows, limit)


def from_reddit(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """Posts.  Of posts with one link the first stays; a self post then leads to its thread."""
    posts = payloads.select("query_id", "query", F.posexplode(F.from_json("payload", REDDIT)["data"]["children"]["data"]).alias("pos", "post")).where("post IS NOT NULL")
    p = F.col("post")
    thread = F.concat(F.lit(REDDIT_HOME), F.coalesce(p["permalink"], F.lit("undefined")))
    link = F.when(p["url"].startswith("http"), p["url"]).otherwise(thread)
    posts = merge.first_seen(posts.withColumn("link", link), ["query_id", "link"], ["pos"])
    fallback = F.concat(F.lit("r/"), _text(p["subreddit"]), F.lit(" · "), F.coalesce(p["score"], F.lit(0)).cast("string"), F.lit(" points"))
    selftext = T.truncate(_text(p["selftext"]), rules.SELFTEXT_LENGTH)
    rows = posts.select(
        "query_id",
        "query",
        "pos",
        _text(p["title"]).alias("title"),
        F.when(F.coalesce(p["is_self"], F.lit(False)), thread).otherwise(F.col("link")).alias("url"),
        T.truncate(F.when(selftext != "", selftext).otherwise(fallback), rules.SNIPPET_LENGTH).alias("snippet"),
    )
    return _cut(_scored(rows, "reddit"), limit)


def from_github(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """Repositories, once each; forks lose three points, stars give up to five."""
    items = payloads.select("query_id", "query", F.posexplode(F.from_json("payload", GITHUB)["items"]).alias("pos", "repo"))
    r = F.col("repo")
    items = merge.first_seen(items.where(_text(r["html_url"]) != "").withColumn("link", r["html_url"]), ["query_id", "link"], ["pos"])
    topics = F.array_join(F.coalesce(r["topics"], F.array().cast("array<string>")), ", ")
    stars = F.coalesce(r["stargazers_count"], F.lit(0))
    parts = [*T.filled(_text(r["description"])), F.when(topics != "", F.concat(F.lit("Topics: "), topics)), F.concat(F.lit("★ "), stars.cast("string"))]
    rows = items.select(
        "query_id",
        "query",
        "pos",
        _first_filled(_text(r["full_name"]), _text(r["name"])).alias("title"),
        F.col("link").alias("url"),
        T.truncate(F.concat_ws(" · ", *parts), rules.SNIPPET_LENGTH).alias("snippet"),
        (S.fork_penalty(r["fork"]) + S.star_bonus(stars)).alias("extra"),
    )
    u = urls.parse(F.col("url"))
    base = S.base_score(T.keyword_tokens(F.col("query")), u, F.col("title"), F.col("snippet"))
    pos = F.row_number().over(merge.W.partitionBy("query_id").orderBy("pos")) - 1
    out = rows.select("query_id", pos.alias("pos"), "title", "url", "snippet", (base + F.col("extra")).cast("int").alias("score"), u["domain"].alias("domain"), F.lit("github").alias("engine"))
    return _cut(out, limit)


def from_wikipedia(searches: DataFrame, extracts: DataFrame, limit: int = 5) -> DataFrame:
    """Articles: search hits in their order, joined to the pages' extracts by page id.  Missing and disambiguation pages go.

    searches and extracts: ``query_id, query, payload``, the two responses of a search.
    """
    hits = searches.select("query_id", "query", F.posexplode(F.from_json("payload", WIKI_SEARCH)["query"]["search"]).alias("pos", "hit"))
    pages = extracts.select("query_id", F.explode(F.from_json("payload", WIKI_PAGES)["query"]["pages"]).alias("id", "page"))
    p = F.col("page")
    joined = hits.withColumn("id", F.col("hit.pageid").cast("string")).join(pages, ["query_id", "id"])
    extract = _text(p["extract"])
    listing = F.lower(extract).contains("may refer to:") & (F.length(extract) < 500)
    named = _text(p["title"]).endswith("(disambiguation)")
    kept = joined.where((_text(p["missing"]) == "") & ~listing & ~named)
    rows = kept.select(
        "query_id",
        "query",
        "pos",
        _first_filled(_text(p["title"]), _text(F.col("hit.title"))).alias("title"),
        _first_filled(_text(p["fullurl"]), F.concat(F.lit(WIKI_HOME), urls.encode_component(_text(p["title"])))).alias("url"),
        T.truncate(T.strip_html(extract), rules.SNIPPET_LENGTH).alias("snippet"),
    )
    return _cut(_scored(rows, "wikipedia"), limit)


def from_brave(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """Web results of the API; not made unique."""
    items = payloads.select("query_id", "query", F.posexplode(F.from_json("payload", BRAVE)["web"]["results"]).alias("pos", "item"))
    i = F.col("item")
    rows = items.select("query_id", "query", "pos", _text(i["title"]).alias("title"), _text(i["url"]).alias("url"), T.truncate(_text(i["description"]), rules.SNIPPET_LENGTH).alias("snippet"))
    return _cut(_scored(merge.non_empty(rows), "brave"), limit)


def shape_error(engine: str, payload: Column, status: Column) -> Column:
    """Why a response can't be used, or null: its HTTP status, then its shape."""
    schema, part = {
        "reddit": (REDDIT, lambda x: x["data"]["children"]),
        "github": (GITHUB, lambda x: x["items"]),
        "brave": (BRAVE, lambda x: x["web"]["results"]),
        "wikipedia": ("STRUCT<query: STRUCT<search: ARRAY<STRUCT<pageid: BIGINT>>>>", lambda x: F.lit(1)),
    }[engine]
    name = {"reddit": "Reddit", "github": "GitHub", "brave": "Brave", "wikipedia": "Wikipedia"}[engine]
    out = F.lit(None).cast("string")
    if engine == "github":
        out = F.when(status == 403, "GitHub API: rate limited (403)")
    elif engine == "brave":
        out = F.when(status.isin(401, 403), F.concat(F.lit("Brave API: authentication failed ("), status.cast("string"), F.lit(")")))
    bad = (status < 200) | (status > 299)
    out = F.coalesce(out, F.when(bad, F.concat(F.lit(f"{name} API: HTTP "), status.cast("string"))))
    return F.coalesce(out, F.when(part(F.from_json(payload, schema)).isNull(), f"{name} API: unexpected response shape"))


def request_size(engine: str, limit: int) -> int:
    """How many rows to ask a source for, so that the cap on domains has slack."""
    if engine in ("google", "bing"):
        return 10
    more, most = rules.REQUEST_SIZE.get(engine, (rules.FETCH_SLACK, 10**6))
    return min(limit + more, most)


def uses_brave_api(mode: str, key: str) -> bool:
    return mode == "api" or (mode != "scrape" and bool(key))
