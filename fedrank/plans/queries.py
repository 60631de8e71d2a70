"""Named queries: one for each operator of the engine, over the driver's tables.  Each gives scalar columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls
from ..operators import merge, metrics, settlement, stateful
from ..sources import html, payloads, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The driver's events are sparse, so limits are tried with windows of days; fixed values.
DAY_MS = 86_400_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.hits(pages(spark, sf_dir))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.queries(pages(spark, sf_dir))


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.settlements(asked(spark, sf_dir))


def joined(array) -> F.Column:
    return F.array_join(array, "+")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", at.alias("at_ms"))


@query
def url_parse(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.parse(F.col("url")).alias("u")).select("page_id", "u.*")


@query
def url_registrable_domain(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.registrable_domain(F.col("url")).alias("domain"))


@query
def url_dedup_key(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.dedup_key(F.col("url")).alias("dedup_key"))


@query
def url_without_params(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.without_params(urls.parse(F.col("url"))["query"]).alias("query"))


@query
def url_unwrap_ddg(spark, sf_dir):
    href = F.concat(F.lit("//duckduckgo.com/l/?uddg="), urls.encode_component(F.col("url")), F.lit("&rut=1"))
    wrapped = F.when(F.col("page_id") % 3 == 0, href).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("https://duckduckgo.com/y.js?ad=1")
    return pages(spark, sf_dir).select("page_id", urls.unwrap_ddg(wrapped).alias("target"))


@query
def url_unwrap_bing(spark, sf_dir):
    code = F.translate(F.regexp_replace(F.regexp_replace(F.base64(F.col("url").cast("binary")), "[\r\n]", ""), "=+$", ""), "+/", "-_")
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.bing.com/ck/a?p=1&u=a1"), code, F.lit("&ntb=1"))).otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", urls.unwrap_bing(wrapped).alias("target"))


@query
def url_search_request(spark, sf_dir):
    q = asked(spark, sf_dir)
    return q.select("query_id", urls.search_url("https://search.example.com/", F.col("query"), source="web").alias("request"), urls.encode_component(F.col("query")).alias("component"))


def _raw_title() -> F.Column:
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


def _raw_body() -> F.Column:
    return F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)


@query
def text_decode_entities(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.decode_entities(F.concat(_raw_title(), F.lit(" &amp;lt; &nbsp; &QUOT; "), _raw_body())).alias("decoded"))


@query
def text_strip_html(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.strip_html(_raw_body()).alias("stripped"))


@query
def text_keyword_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", joined(T.keyword_tokens(F.col("text"))).alias("tokens"))


@query
def text_overlap(spark, sf_dir):
    tokens = T.keyword_tokens(F.regexp_replace(_raw_title(), "[^A-Za-z ]", " "))
    return pages(spark, sf_dir).select("page_id", T.overlap(F.lower(_raw_body()), tokens, 2).alias("score"))


@query
def text_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 120).alias("cut"))


@query
def text_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query
def text_normalise_content(spark, sf_dir):
    text = F.regexp_replace(F.col("text"), "\n", "\n\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalise_content(text, 5000), 256).alias("content_sha256"))


@query
def cache_keys(spark, sf_dir):
    engines = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("google"), F.lit("bing")))
    return asked(spark, sf_dir).select("query_id", T.cache_key(F.concat(F.lit("  "), F.upper("query")), engines, F.col("limit")).alias("cache_key"))


@query
def intent(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", S.detect_intent(F.col("query")).alias("intent"))


@query
def intent_of_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(S.detect_intent(F.col("text")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def scored_hits(spark, sf_dir) -> DataFrame:
    rows = serp(spark, sf_dir).join(merge.with_intent(asked(spark, sf_dir)), "query_id").withColumn("u", urls.parse(F.col("url")))
    return rows.withColumn("score", S.base_score(T.keyword_tokens(F.col("query")), F.col("u"), F.col("title"), F.col("snippet")))


@query
def score_base(spark, sf_dir):
    return scored_hits(spark, sf_dir).select("query_id", "engine", "pos", "score")


@query
def score_intent_adjustment(spark, sf_dir):
    return scored_hits(spark, sf_dir).select("query_id", "engine", "pos", S.intent_adjustment(F.col("intent"), F.col("u")).alias("adjustment"))


@query
def score_predicates(spark, sf_dir):
    u = F.col("u")
    confident = S.high_confidence(F.col("intent"), u, F.col("score"))
    return scored_hits(spark, sf_dir).select("query_id", "engine", "pos", S.officialish(u).alias("officialish"), S.known_official(u).alias("known"), confident.alias("confident"))


@query
def score_star_bonus(spark, sf_dir):
    stars = F.floor(F.col("o_totalprice")).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", (S.star_bonus(stars) + S.fork_penalty(F.col("o_orderstatus") == "F")).alias("extra"))


@query
def serp_hits(spark, sf_dir):
    return serp(spark, sf_dir)


@query
def serp_union(spark, sf_dir):
    rows = serp(spark, sf_dir)
    both = merge.union_sources(rows.where(F.col("engine").isin("ddg", "bing")), rows.where(~F.col("engine").isin("ddg", "bing")))
    return both.groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


@query
def serp_first_seen(spark, sf_dir):
    """In-source rows made unique by URL, the first stays."""
    keyed = pages(spark, sf_dir).select("page_id", urls.parse(F.col("url"))["domain"].alias("domain"))
    return merge.first_seen(keyed, ["domain"], ["page_id"])


@query
def serp_engine_limit(spark, sf_dir):
    return merge.per_engine_limit(merge.non_empty(serp(spark, sf_dir)), 5).select("query_id", "engine", "pos", "url")


@query
def engine_ranks(spark, sf_dir):
    rows = serp(spark, sf_dir).join(merge.with_intent(asked(spark, sf_dir)), "query_id")
    return rows.select("query_id", "engine", merge.engine_rank(F.col("intent"), F.col("engine")).alias("rank")).distinct()


@query
def engines_attempted(spark, sf_dir):
    wanted = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("github"), F.lit("brave"), F.lit("bing"), F.lit("nowhere")))
    return merge.with_intent(asked(spark, sf_dir)).select("query_id", joined(merge.attempted(F.col("intent"), wanted)).alias("attempted"))


@query
def merged_groups(spark, sf_dir):
    rows = merge.merged(serp(spark, sf_dir), asked(spark, sf_dir))
    return rows.select("query_id", "dedup_key", "title", "url", "snippet", joined("engines").alias("engines"), "base", "boost", "adjustment", "score", "domain", F.col("n").alias("n_rows"))


@query
def domain_cap(spark, sf_dir):
    return merge.cap_domains(merge.merged(serp(spark, sf_dir), asked(spark, sf_dir))).select("query_id", "dedup_key", "score")


@query
def ranked_results(spark, sf_dir):
    return merge.rank_results(serp(spark, sf_dir), asked(spark, sf_dir)).withColumn("engines", joined("engines"))


@query
def selected_fields(spark, sf_dir):
    return merge.select_fields(merge.rank_results(serp(spark, sf_dir), asked(spark, sf_dir)), ["rank", "url", "query_id", "nothing"])


@query
def response_envelopes(spark, sf_dir):
    rows = merge.envelopes(merge.rank_results(serp(spark, sf_dir), asked(spark, sf_dir)), asked(spark, sf_dir))
    return rows.select("query_id", "query", "total", joined(F.transform("results", lambda r: r["url"])).alias("urls"))


@query
def documents_per_source(spark, sf_dir):
    """The cap as a plain operator: the two longest documents of each source."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.lit(0).alias("query_id"), F.col("source").alias("domain"), F.col("n_chars").alias("score"), F.col("doc_id").alias("first_seq"))
    return merge.cap_domains(rows).select("doc_id", "domain", "score")


@query
def engine_counts(spark, sf_dir):
    return serp(spark, sf_dir).groupBy("query_id", "engine").agg(F.count(F.lit(1)).alias("n"))


@query
def engine_statistics(spark, sf_dir):
    rows = settlement.engine_stats(settlements(spark, sf_dir), serp(spark, sf_dir), asked(spark, sf_dir))
    names = [joined(c).alias(c) for c in ("attempted", "completed", "failed", "pending")]
    total = F.aggregate(F.map_values("counts"), F.lit(0), lambda a, b: a + b).alias("n_rows")
    return rows.select("query_id", "intent", *names, total, F.size("errors").alias("n_errors"), "partial")


@query
def settlement_timeouts(spark, sf_dir):
    return settlement.apply_timeouts(settlements(spark, sf_dir), 4000, 3000)


@query
def fast_path(spark, sf_dir):
    return settlement.fast_path(settlements(spark, sf_dir), serp(spark, sf_dir), asked(spark, sf_dir))


@query
def search_answers(spark, sf_dir):
    rows = settlement.answers(serp(spark, sf_dir), settlements(spark, sf_dir), asked(spark, sf_dir))
    urls_ = joined(F.transform("results", lambda r: r["url"])).alias("urls")
    return rows.select("query_id", "phase", "total", "partial", "elapsed_ms", "intent", joined("stats.pending").alias("pending"), urls_)


@query
def search_answers_final(spark, sf_dir):
    rows = settlement.answers(serp(spark, sf_dir), settlements(spark, sf_dir), asked(spark, sf_dir), await_background=True)
    return rows.select("query_id", "phase", "total", "partial", "elapsed_ms", "intent", joined("stats.failed").alias("failed"))


@query
def request_counts(spark, sf_dir):
    return metrics.request_counts(table(spark, sf_dir, "events"), "event_type")


@query
def last_seen(spark, sf_dir):
    return metrics.last_seen(events(spark, sf_dir), "event_type", ["at_ms", "event_id"], ["event_id", "user_id", "at_ms"])


@query
def last_failures(spark, sf_dir):
    return metrics.last_failures(settlements(spark, sf_dir).withColumn("error", F.concat("error", F.lit(" in "), F.col("query_id").cast("string"))), ["query_id", "arrival_ms"])


@query
def conversation_last_turn(spark, sf_dir):
    return metrics.last_seen(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role", "turn"])


@query
def rate_limit(spark, sf_dir):
    return stateful.rate_limit(events(spark, sf_dir).select("event_id", "user_id", "at_ms"), "user_id", "at_ms", ["event_id"], 3, 3 * DAY_MS)


@query
def cool_down(spark, sf_dir):
    log = events(spark, sf_dir).select("event_id", "user_id", "at_ms", (F.col("event_type") == "error").alias("challenged"))
    return stateful.cool_down(log, "user_id", "at_ms", "challenged", ["event_id"], 2 * DAY_MS)


@query
def single_flight(spark, sf_dir):
    log = events(spark, sf_dir).select("event_id", "user_id", "at_ms", F.lit(DAY_MS).alias("duration"))
    return stateful.single_flight(log, "user_id", "event_id", "at_ms", "duration")


def _request_log(spark, sf_dir) -> DataFrame:
    log = events(spark, sf_dir)
    return log.select("event_id", (F.col("user_id") % 8).alias("instance"), (F.col("user_id") % 60).cast("string").alias("key"), "at_ms", F.lit(DAY_MS // 24).alias("duration"))


@query
def result_cache(spark, sf_dir):
    return stateful.cache(_request_log(spark, sf_dir), "instance", "key", "event_id", "at_ms", "duration", 2 * DAY_MS, 5)


@query
def result_cache_stats(spark, sf_dir):
    return metrics.cache_stats(result_cache(spark, sf_dir))


@query
def slot_queue(spark, sf_dir):
    return stateful.queue(_request_log(spark, sf_dir).drop("key"), "instance", "event_id", "at_ms", "duration", 2)


def _page_rows(spark, sf_dir) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", "url", _raw_title().alias("title"), _raw_body().alias("body"))
    return rows.withColumn("query_id", F.floor(F.col("page_id") / 8).cast("long")).withColumn("query", F.lit("example docs api"))


def _payload(rows: DataFrame, item: F.Column, wrap) -> DataFrame:
    """One response for each eight pages, as JSON text."""
    listed = rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))).alias("x"))
    return listed.select("query_id", "query", F.to_json(wrap(F.transform("x", lambda r: r["item"]))).alias("payload"))


@query
def source_reddit(spark, sf_dir):
    p = F.col("page_id")
    post = F.struct(
        F.when(p % 4 == 0, F.col("url")).otherwise(F.concat(F.lit("/r/x/"), (p % 3).cast("string"))).alias("url"),
        F.concat(F.lit("/r/x/"), p.cast("string")).alias("permalink"),
        (p % 2 == 1).alias("is_self"),
        "title",
        F.when(p % 5 == 0, "").otherwise(F.col("body")).alias("selftext"),
        F.lit("x").alias("subreddit"),
        p.alias("score"),
    )
    wrap = lambda items: F.struct(F.struct(F.transform(items, lambda i: F.struct(i.alias("data"))).alias("children")).alias("data"))
    return payloads.from_reddit(_payload(_page_rows(spark, sf_dir), post, wrap), 6)


@query
def source_github(spark, sf_dir):
    p = F.col("page_id")
    repo = F.struct(
        F.when(p % 7 != 0, F.col("url")).alias("html_url"),
        F.when(p % 2 == 0, F.col("title")).alias("full_name"),
        F.lit("name").alias("name"),
        F.when(p % 3 == 0, F.col("body")).alias("description"),
        F.when(p % 5 == 0, F.array(F.lit("search"), F.lit("api"))).alias("topics"),
        (p * 37).alias("stargazers_count"),
        (p % 4 == 0).alias("fork"),
    )
    return payloads.from_github(_payload(_page_rows(spark, sf_dir), repo, lambda items: F.struct(items.alias("items"))), 6)


@query
def source_wikipedia(spark, sf_dir):
    rows, p = _page_rows(spark, sf_dir), F.col("page_id")
    hit = F.struct(p.alias("pageid"), F.col("title").alias("title"))
    found = _payload(rows, hit, lambda items: F.struct(F.struct(items.alias("search")).alias("query")))
    extract = F.when(p % 6 == 0, F.concat("title", F.lit(" may refer to: "), F.when(p % 4 == 0, F.col("body")).otherwise(""))).otherwise(F.col("body"))
    page = F.struct(
        F.when(p % 9 == 0, F.concat("title", F.lit(" (disambiguation)"))).otherwise(F.col("title")).alias("title"),
        extract.alias("extract"),
        F.when(p % 2 == 0, F.col("url")).alias("fullurl"),
        F.when(p % 5 == 0, "1").alias("missing"),
    )
    listed = rows.where(p % 7 != 0).groupBy("query_id", "query").agg(F.map_from_entries(F.collect_list(F.struct(p.cast("string").alias("k"), page.alias("v")))).alias("pages"))
    extracts = listed.select("query_id", "query", F.to_json(F.struct(F.struct("pages").alias("query"))).alias("payload"))
    return payloads.from_wikipedia(found, extracts, 5)


@query
def source_brave(spark, sf_dir):
    p = F.col("page_id")
    item = F.struct(F.when(p % 5 != 0, F.col("title")).alias("title"), "url", F.col("body").alias("description"))
    return payloads.from_brave(_payload(_page_rows(spark, sf_dir), item, lambda items: F.struct(F.struct(items.alias("results")).alias("web"))), 6)


@query
def source_shape_errors(spark, sf_dir):
    p = F.col("page_id")
    engines = ("github", "reddit", "brave", "wikipedia")
    status = F.when(p % 5 == 0, 403).when(p % 5 == 1, 500).when(p % 5 == 2, 401).otherwise(200)
    body = F.when(p % 3 == 0, '{"items": [], "data": {"children": []}, "web": {"results": []}}').otherwise('{"other": 1}')
    rows = pages(spark, sf_dir).select("page_id", F.explode(F.array(*map(F.lit, engines))).alias("engine"), body.alias("body"), status.alias("status"))
    error = F.lit(None).cast("string")
    for engine in engines:
        error = F.when(F.col("engine") == engine, payloads.shape_error(engine, F.col("body"), F.col("status"))).otherwise(error)
    return rows.select("page_id", "engine", error.alias("error"))


@query
def extracted_pages(spark, sf_dir):
    return html.extract_pages(pages(spark, sf_dir))


@query
def source_search_pages(spark, sf_dir):
    """Search pages of one engine, built from eight pages each, and read back."""
    item = F.concat(F.lit('<li class="b_algo"><h2><a href="'), F.col("url"), F.lit('">'), F.col("title"), F.lit('</a></h2><div class="b_caption"><p>'), F.regexp_replace("body", "<[^>]*>", " "), F.lit("</p></div></li>"))
    rows = _page_rows(spark, sf_dir).groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))).alias("x"))
    built = rows.select("query_id", "query", F.concat(F.lit("<html><body><ol>"), F.array_join(F.transform("x", lambda r: r["item"]), ""), F.lit("</ol></body></html>")).alias("html"))
    return html.from_search_pages(built, "bing", 6)
