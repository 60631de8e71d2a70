"""Counters and last-seen values of a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_counts(log: DataFrame, kind: str) -> DataFrame:
    return log.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def last_seen(log: DataFrame, kind: str, order: list[str], values: list[str]) -> DataFrame:
    """The latest row's values for each kind."""
    at = F.struct(*order)
    return log.groupBy(kind).agg(*[F.max_by(v, at).alias(f"last_{v}") for v in values])


def last_failures(settlement: DataFrame, order: list[str]) -> DataFrame:
    """The latest error of each engine; a later success does not clear it."""
    failed = settlement.where(~F.col("ok"))
    return failed.groupBy("engine").agg(F.max_by("error", F.struct(*order)).alias("error"), F.count(F.lit(1)).alias("n"))


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """Hits, misses, in-flight hits and writes of each instance; an in-flight hit is also a miss."""
    o = F.col("outcome")
    return outcomes.groupBy("instance").agg(
        F.count_if(o == "hit").alias("hits"), F.count_if(o != "hit").alias("misses"), F.count_if(o == "inflight").alias("inflight_hits"), F.count_if(o == "miss").alias("writes")
    )
