"""From the sources' rows to ranked results.

Row order means something in a search: which source answered first decides titles and ties.  It is carried as ``seq``
(arrival, rank of the engine for the intent, position), and every choice is made by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls
from ..plans import rules


def engine_rank(intent: Column, engine: Column) -> Column:
    """The engine's place in the intent's order, from 0; 99 if it has none."""
    out = F.lit(None).cast("int")
    for name, order in rules.ENGINE_ORDER.items():
        place = F.array_position(F.array(*map(F.lit, order)), engine).cast("int") - 1
        out = F.when(intent == name, F.when(place >= 0, place)).otherwise(out)
    return F.coalesce(out, F.lit(rules.UNRANKED))


def default_engines(enable_brave: bool = False) -> list[str]:
    return [e for e in rules.ENGINES if e != "brave" or enable_brave]


def attempted(intent: Column, engines: Column, enable_brave: bool = False) -> Column:
    """Engines of a search in the intent's order: those enabled and, if ``engines`` is not null, listed in it."""
    allowed = default_engines(enable_brave)
    out = F.array().cast("array<string>")
    for name, order in rules.ENGINE_ORDER.items():
        out = F.when(intent == name, F.array(*[F.lit(e) for e in order if e in allowed])).otherwise(out)
    return F.when(engines.isNull(), out).otherwise(F.filter(out, lambda e: F.array_contains(engines, e)))


def with_intent(queries: DataFrame) -> DataFrame:
    return queries.withColumn("intent", S.detect_intent(F.col("query")))


def union_sources(*sources: DataFrame) -> DataFrame:
    """UNION ALL of the sources' rows, by column name."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out


def non_empty(rows: DataFrame) -> DataFrame:
    """Rows with a title and a URL."""
    return rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def per_engine_limit(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.col("pos") < limit)


def merge_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each page: earliest title, longest snippet, shortest URL (earliest of equals), all engines in order.

    An engine that gives the page twice is there twice.  ``rows`` need ``seq`` and ``dedup_key``.  One aggregation, so one
    shuffle.
    """
    seq = F.col("seq")
    late = F.struct(*(-seq[k] for k in ("arrival_ms", "rank", "pos")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "engine")))
    return rows.groupBy(*by, "dedup_key").agg(
        F.min_by("title", seq).alias("title"),
        F.min_by("url", F.struct(F.length("url").alias("n"), seq.alias("s"))).alias("url"),
        F.max_by("snippet", F.struct(F.length("snippet").alias("n"), late.alias("s"))).alias("snippet"),
        F.transform(ordered, lambda x: x["engine"]).alias("engines"),
        F.min(seq).alias("first_seq"),
        F.count(F.lit(1)).alias("n"),
    )


def add_seq(rows: DataFrame) -> DataFrame:
    rank = engine_rank(F.col("intent"), F.col("engine"))
    return rows.withColumn("seq", F.struct(F.col("arrival_ms").alias("arrival_ms"), rank.alias("rank"), F.col("pos").alias("pos")))


def score_groups(groups: DataFrame, distinct_engines: bool = False) -> DataFrame:
    """Adds ``domain, base, boost, adjustment, score``; the URL is parsed once, the tokens are made once."""
    n = F.size(F.array_distinct("engines")) if distinct_engines else F.col("n")
    ready = groups.withColumn("u", urls.parse(F.col("url"))).withColumn("tokens", T.keyword_tokens(F.col("query")))
    u = F.col("u")
    scored = ready.withColumn("base", S.base_score(F.col("tokens"), u, F.col("title"), F.col("snippet")))
    scored = scored.withColumn("boost", S.cross_engine_boost(n)).withColumn("adjustment", S.intent_adjustment(F.col("intent"), u))
    return scored.withColumn("score", F.col("base") + F.col("boost") + F.col("adjustment")).withColumn("domain", u["domain"]).drop("u", "tokens")


def cap_domains(rows: DataFrame, most: int = rules.MAX_PER_DOMAIN, by: str = "query_id") -> DataFrame:
    """At most ``most`` rows of a domain for each query, by score; rows without a domain count as one."""
    bucket = F.when(F.coalesce("domain", F.lit("")) == "", "unknown").otherwise(F.col("domain"))
    w = W.partitionBy(by, bucket).orderBy(F.desc("score"), "first_seq")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def rank_rows(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Ranks from 1 by score, earlier first, and no more than the query's limit."""
    w = W.partitionBy(by).orderBy(F.desc("score"), "first_seq")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("limit"))


def project(rows: DataFrame) -> DataFrame:
    """The columns of a result."""
    title = T.truncate(T.decode_entities(F.coalesce("title", F.lit(""))), rules.TITLE_LENGTH)
    snippet = T.truncate(T.decode_entities(F.coalesce("snippet", F.lit(""))), rules.SNIPPET_LENGTH)
    return rows.select("query_id", title.alias("title"), "url", snippet.alias("snippet"), "score", "engines", "rank")


def merged(serp: DataFrame, queries: DataFrame, distinct_engines: bool = False) -> DataFrame:
    """Scored groups of a batch of searches, before caps and ranks."""
    joined = serp.join(with_intent(queries).select("query_id", "query", "limit", "intent"), "query_id")
    keyed = add_seq(joined).withColumn("dedup_key", urls.dedup_key(F.col("url")))
    return score_groups(merge_groups(keyed, ["query_id", "query", "limit", "intent"]), distinct_engines)


def rank_results(serp: DataFrame, queries: DataFrame, distinct_engines: bool = False) -> DataFrame:
    """Ranked results of every query: ``query_id, title, url, snippet, score, engines, rank``.

    serp: ``query_id, engine, arrival_ms, pos, title, url, snippet``; queries: ``query_id, query, limit``.
    """
    return project(rank_rows(cap_domains(merged(serp, queries, distinct_engines))))


def select_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Only the named columns, in the rows' order of columns; unknown names don't matter."""
    return rows.select(*[c for c in rows.columns if c in set(fields)])


def envelopes(results: DataFrame, queries: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row for each query: ``query_id, query, results`` (in rank order) ``, total, partial``."""
    row = F.struct("rank", "title", "url", "snippet", "score", "engines")
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
    out = queries.select("query_id", "query").join(listed, "query_id", "left")
    none = F.array().cast(listed.schema["results"].dataType)
    out = out.withColumn("results", F.coalesce("results", none)).withColumn("total", F.size("results"))
    if stats is None:
        return out
    return out.join(stats, "query_id", "left")
