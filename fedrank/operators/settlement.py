"""Which sources answered, when, and when a search may be answered early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import urls
from ..plans import rules
from . import merge

NEVER = 2**31 - 1


def profile(intent: Column) -> Column:
    """The intent's profile as a struct; unknown intents have that of ``general``."""
    names = ("min_settled", "min_useful", "useful", "soft_ms", "hard_ms", "needs_confidence")

    def struct(intent_name: str) -> Column:
        values = rules.PROFILES[intent_name]
        return F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)).alias(n) for n, v in zip(names, values, strict=True)])

    out = struct("general")
    for name in rules.INTENTS[:-1]:
        out = F.when(intent == name, struct(name)).otherwise(out)
    return out


def apply_timeouts(settlement: DataFrame, search_ms: int = 10_000, api_ms: int = 8_000) -> DataFrame:
    """Sources that take longer than their timeout fail at it; API sources have their own."""
    most = F.when(F.col("engine").isin(list(rules.API_ENGINES)), api_ms).otherwise(search_ms)
    late = F.col("arrival_ms") > most
    return settlement.select(
        "query_id",
        "engine",
        F.least("arrival_ms", most).alias("arrival_ms"),
        (F.col("ok") & ~late).alias("ok"),
        F.when(late, F.concat(F.lit("timeout after "), most.cast("string"), F.lit(" ms"))).otherwise(F.col("error")).alias("error"),
    )


def confident_engines(serp: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, engine`` of engines with a row of high confidence among their first three."""
    rows = serp.where(F.col("pos") < 3).join(merge.with_intent(queries).select("query_id", "query", "intent"), "query_id")
    rows = rows.withColumn("u", urls.parse(F.col("url")))
    if "score" not in serp.columns:
        rows = rows.withColumn("score", S.score_url(F.col("query"), F.col("url"), F.col("title"), F.col("snippet")))
    return rows.where(S.high_confidence(F.col("intent"), F.col("u"), F.col("score"))).select("query_id", "engine").distinct()


def _kth(times: Column, k: Column) -> Column:
    return F.coalesce(F.get(F.array_sort(times), k - 1), F.lit(NEVER))


def fast_path(settlement: DataFrame, serp: DataFrame, queries: DataFrame, poll_ms: int = rules.POLL_MS) -> DataFrame:
    """When each search may be answered: ``query_id, intent, settled_all, resolve_ms``.

    All conditions only ever become true, so the moment is a formula over order statistics of the settle times, rounded up to
    the next poll; nothing is simulated.  A search of no source is answered at once.
    """
    counts = serp.groupBy("query_id", "engine").agg(F.count(F.lit(1)).alias("n_rows"))
    sure = confident_engines(serp, queries).withColumn("sure", F.lit(True))
    known = settlement.join(counts, ["query_id", "engine"], "left").join(sure, ["query_id", "engine"], "left")
    asked = merge.with_intent(queries).withColumn("p", profile(F.col("intent"))).select("query_id", "intent", "p")
    rows = asked.join(known, "query_id", "left")
    useful = F.col("ok") & (F.coalesce("n_rows", F.lit(0)) > 0) & F.array_contains(F.col("p.useful"), F.col("engine"))
    times = rows.groupBy("query_id", "intent", "p").agg(
        F.collect_list("arrival_ms").alias("settled"),
        F.collect_list(F.when(useful, F.col("arrival_ms"))).alias("useful"),
        F.coalesce(F.min(F.when(F.col("ok") & F.col("sure"), F.col("arrival_ms"))), F.lit(NEVER)).alias("confident"),
        F.coalesce(F.max("arrival_ms"), F.lit(0)).alias("settled_all"),
    )
    p = F.col("p")
    early = F.greatest(
        _kth(F.col("settled"), p["min_settled"]),
        _kth(F.col("useful"), p["min_useful"]),
        F.when(p["needs_confidence"], F.col("confident")).otherwise(0),
        F.least(p["soft_ms"], F.col("confident")),
    )
    moment = F.least("settled_all", p["hard_ms"], early)
    return times.select("query_id", "intent", "settled_all", (F.ceil(moment / poll_ms) * poll_ms).cast("int").alias("resolve_ms"))


def engine_stats(settlement: DataFrame, serp: DataFrame, queries: DataFrame, until: DataFrame | None = None, enable_brave: bool = False) -> DataFrame:
    """Of each query: arrays ``attempted, completed, failed, pending`` in the intent's order, maps ``counts`` and ``errors``, and ``partial``.

    ``until`` (``query_id, resolve_ms``) leaves out what settled later.  The one group of a query has a row for each engine.
    """
    seen = settlement if until is None else settlement.join(until.select("query_id", "resolve_ms"), "query_id").where("arrival_ms <= resolve_ms").drop("resolve_ms")
    counts = serp.groupBy("query_id", "engine").agg(F.count(F.lit(1)).cast("int").alias("n_rows"))
    row = F.struct("engine", "ok", F.coalesce("n_rows", F.lit(0)).alias("n"), "error")
    listed = seen.join(counts, ["query_id", "engine"], "left").groupBy("query_id").agg(F.collect_list(row).alias("rows"))
    asked = merge.with_intent(queries)
    engines = F.col("engines") if "engines" in queries.columns else F.lit(None).cast("array<string>")
    base = asked.select("query_id", "intent", merge.attempted(F.col("intent"), engines, enable_brave).alias("attempted")).join(listed, "query_id", "left")
    base = base.withColumn("rows", F.coalesce("rows", F.array().cast(listed.schema["rows"].dataType)))

    def names(test) -> Column:
        found = F.transform(F.filter("rows", test), lambda r: r["engine"])
        return F.filter("attempted", lambda e: F.array_contains(found, e))

    out = base.withColumn("completed", names(lambda r: r["ok"])).withColumn("failed", names(lambda r: ~r["ok"]))
    out = out.withColumn("pending", F.array_except(F.array_except("attempted", "completed"), "failed"))
    wanted = F.filter("rows", lambda r: F.array_contains(F.col("attempted"), r["engine"]))
    count_map = F.map_from_entries(F.transform(wanted, lambda r: F.struct(r["engine"], F.when(r["ok"], r["n"]).otherwise(0))))
    error_map = F.map_from_entries(F.transform(F.filter(wanted, lambda r: ~r["ok"]), lambda r: F.struct(r["engine"], r["error"])))
    partial = (F.size("pending") > 0) | (F.size("failed") > 0)
    return out.select("query_id", "intent", "attempted", "completed", "failed", "pending", count_map.alias("counts"), error_map.alias("errors"), partial.alias("partial"))


def answers(serp: DataFrame, settlement: DataFrame, queries: DataFrame, await_background: bool = False, enable_brave: bool = False) -> DataFrame:
    """A search from end to end, with both phases.

    Returns ``query_id, phase, results, total, partial, stats, elapsed_ms, intent``.  ``fast`` is what is known when the
    search may be answered; ``final`` what is known when all sources have settled, given where that differs (or, with
    ``await_background``, always and alone).
    """
    allowed = merge.with_intent(queries)
    engines = F.col("engines") if "engines" in queries.columns else F.lit(None).cast("array<string>")
    allowed = allowed.withColumn("attempted", merge.attempted(F.col("intent"), engines, enable_brave))
    use = allowed.select("query_id", F.explode("attempted").alias("engine"))
    settlement = settlement.join(use, ["query_id", "engine"], "left_semi")
    serp = serp.join(settlement.where("ok").select("query_id", "engine"), ["query_id", "engine"], "left_semi")
    moments = fast_path(settlement, serp, queries)
    last = F.greatest("resolve_ms", "settled_all")
    fast, final = (F.struct(F.lit(name).alias("phase"), at.alias("elapsed_ms")) for name, at in (("fast", F.col("resolve_ms")), ("final", last)))
    phases = F.array(final) if await_background else F.when(F.col("settled_all") > F.col("resolve_ms"), F.array(fast, final)).otherwise(F.array(fast))
    # a phase of a search is ranked as if it were a search of its own, so both go through one merge
    key = F.struct("query_id", "p.phase", "p.elapsed_ms", "intent")
    runs = moments.withColumn("p", F.explode(phases)).select("query_id", key.alias("key"))
    keyed = lambda rows: rows.join(runs, "query_id").drop("query_id").withColumnRenamed("key", "query_id")
    in_time = lambda rows: keyed(rows).where(F.col("arrival_ms") <= F.col("query_id.elapsed_ms"))
    rows, asked = in_time(serp), keyed(queries)
    stats = engine_stats(in_time(settlement), rows, asked, enable_brave=enable_brave)
    packed = stats.select("query_id", "partial", F.struct("attempted", "completed", "failed", "pending", "counts", "errors").alias("stats"))
    out = merge.envelopes(merge.rank_results(rows, asked), asked, packed)
    return out.select("query_id.query_id", "query_id.phase", "results", "total", "partial", "stats", "query_id.elapsed_ms", "query_id.intent")
