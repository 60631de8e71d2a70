"""The stateful operators on streams, with the state machines of the batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import stateful
from ..plans import rules


def _stream(
    log: DataFrame, key: str, order: list[str], state_schema: str, load: Callable[[tuple | None], Any], save: Callable[[Any], tuple], inputs: list[str], outputs: str
) -> DataFrame:
    """Runs a state machine for each key over a stream; rows of a micro-batch are taken in order.  State is as large as the machine's."""
    names = [part.split()[0] for part in outputs.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema) + ", " + outputs

    def run(_key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        machine = load(state.get if state.exists else None)
        made = [machine(*args) for args in zip(*(rows[c] for c in inputs), strict=True)]
        state.update(save(machine))
        yield rows.assign(**{n: [m[i] for m in made] for i, n in enumerate(names)})

    return log.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def rate_limit(log: DataFrame, key: str, at: str, order: list[str], limit: int = rules.RATE_LIMIT, window: int = rules.RATE_WINDOW_MS) -> DataFrame:
    """Adds ``accepted``.  State: the times of at most ``limit`` accepted requests."""
    load = lambda s: stateful.RateLimiter(limit, window, s[0] if s else ())
    return _stream(log, key, [at, *order], "log array<bigint>", load, lambda m: ([int(x) for x in m.log],), [at], "accepted boolean")


def cool_down(log: DataFrame, key: str, at: str, challenged: str, order: list[str], length: int = rules.COOLDOWN_MS) -> DataFrame:
    """Adds ``outcome``.  State: until when requests fail."""
    load = lambda s: stateful.CoolDown(length, s[0]) if s else stateful.CoolDown(length)
    return _stream(log, key, [at, *order], "until bigint", load, lambda m: (int(m.until),), [at, challenged], "outcome string")


def single_flight(log: DataFrame, key: str, request: str, at: str, duration: str) -> DataFrame:
    """Adds ``leader, leader_id``.  State: the running request and its end."""

    def load(s):
        m = stateful.SingleFlight()
        if s:
            m.leader, m.end = s
        return m

    save = lambda m: (None if m.leader is None else int(m.leader), int(m.end))
    return _stream(log, key, [at, request], "leader bigint, end bigint", load, save, [request, at, duration], "leader boolean, leader_id bigint")


def cache(log: DataFrame, instance: str, key: str, request: str, at: str, duration: str, ttl: int = rules.CACHE_TTL_MS, most: int = rules.CACHE_ENTRIES) -> DataFrame:
    """Adds ``outcome, entries``.  State: at most ``most`` entries in the order of their use, and the requests in flight."""

    def load(s):
        m = stateful.Cache(ttl, most)
        if s:
            names, written, ends, numbers, flying, good, m.n = s
            m.entries.update(zip(names, written, strict=True))
            m.landing = list(zip(ends, numbers, flying, good, strict=True))  # a heap as it was
            m.flying = {k: end for end, _, k, _ in m.landing}
        return m

    def save(m):
        ends, numbers, flying, good = ([x[i] for x in m.landing] for i in range(4))
        return list(m.entries), [int(t) for t in m.entries.values()], list(map(int, ends)), list(map(int, numbers)), flying, list(map(bool, good)), m.n

    schema = "names array<string>, written array<bigint>, ends array<bigint>, numbers array<bigint>, flying array<string>, good array<boolean>, n bigint"
    return _stream(log, instance, [at, request], schema, load, save, [at, key, duration], "outcome string, entries bigint")


def queue(log: DataFrame, pool: str, request: str, at: str, duration: str, slots: int = rules.SLOTS) -> DataFrame:
    """Adds ``start, waited``.  State: when each slot is free."""

    def load(s):
        m = stateful.Slots(slots)
        if s:
            m.free = list(s[0])
        return m

    return _stream(log, pool, [at, request], "free array<bigint>", load, lambda m: ([int(x) for x in m.free],), [at, duration], "start bigint, waited bigint")


def request_counts(log: DataFrame, kind: str) -> DataFrame:
    """Running counts for each kind; for output mode ``complete`` or ``update``."""
    return log.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def latest_answers(answers: DataFrame) -> DataFrame:
    """The last answer of each search of a stream of ``query_id, elapsed_ms, phase, ...``: a final phase overwrites a fast one.  For output mode ``update``."""
    rest = [c for c in answers.columns if c != "query_id"]
    return answers.groupBy("query_id").agg(F.max_by(F.struct(*rest), F.struct("elapsed_ms", F.col("phase") == "final")).alias("answer")).select("query_id", "answer.*")
