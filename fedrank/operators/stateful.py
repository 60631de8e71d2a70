"""Operators whose next row depends on all before it: limits, cool-downs, caches, queues.

Each is a small state machine in Python (also used by the streaming forms).  In a batch, rows are dealt by key, sorted, and
read in order; a task holds a batch of rows and one key's state, never a key's whole log.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..plans import rules

Step = Callable[..., tuple]


def in_order(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Step], outputs: str) -> DataFrame:
    """Adds columns that ``start()``'s step gives for each row of a key, in order.  ``inputs`` are the columns it takes."""
    names = [part.split()[0] for part in outputs.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + outputs

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = object(), None
        for frame in frames:
            made: list[tuple[Any, ...]] = []
            for key, args in zip(zip(*(frame[k] for k in keys), strict=True), zip(*(frame[c] for c in inputs), strict=True), strict=True):
                if key != now:
                    now, step = key, start()
                made.append(step(*args))
            yield frame.assign(**{n: [m[i] for m in made] for i, n in enumerate(names)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class RateLimiter:
    """A sliding log: at most ``limit`` accepted requests in a window; rejected ones are not logged."""

    def __init__(self, limit: int = rules.RATE_LIMIT, window: int = rules.RATE_WINDOW_MS, log: Iterable[int] = ()):
        self.limit, self.window, self.log = limit, window, deque(log)

    def __call__(self, at: int) -> tuple[bool]:
        while self.log and self.log[0] < at - self.window:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return (False,)
        self.log.append(at)
        return (True,)


class CoolDown:
    """After a challenge, requests fail without being tried until a time; that does not put the time off."""

    def __init__(self, length: int = rules.COOLDOWN_MS, until: int = -(2**62)):
        self.length, self.until = length, until

    def __call__(self, at: int, challenged: bool) -> tuple[str]:
        if at < self.until:
            return ("blocked",)
        if challenged:
            self.until = at + self.length
            return ("challenged",)
        return ("ok",)


class SingleFlight:
    """Requests that come while one for the same key runs wait for it."""

    def __init__(self):
        self.leader, self.end = None, -(2**62)

    def __call__(self, request: int, at: int, duration: int) -> tuple[bool, int]:
        if at < self.end:
            return False, self.leader
        self.leader, self.end = request, at + duration
        return True, request


class Cache:
    """Least recently used entries with a lifetime from when they were written, and requests in flight."""

    def __init__(self, ttl: int = rules.CACHE_TTL_MS, most: int = rules.CACHE_ENTRIES):
        self.ttl, self.most = ttl, most
        self.entries: OrderedDict[str, int] = OrderedDict()
        self.flying: dict[str, int] = {}
        self.landing: list[tuple[int, int, str, bool]] = []
        self.n = 0

    def _write(self, at: int, key: str) -> None:
        for k in [k for k, t in self.entries.items() if at - t > self.ttl]:
            del self.entries[k]
        self.entries.pop(key, None)
        self.entries[key] = at
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)

    def __call__(self, at: int, key: str, duration: int, ok: bool = True) -> tuple[str, int]:
        while self.landing and self.landing[0][0] <= at:
            end, _, k, good = heapq.heappop(self.landing)
            self.flying.pop(k, None)
            if good:
                self._write(end, k)
        if key in self.entries:
            if at - self.entries[key] <= self.ttl:
                self.entries.move_to_end(key)
                return "hit", len(self.entries)
            del self.entries[key]
        if key in self.flying:
            return "inflight", len(self.entries)
        self.n += 1
        self.flying[key] = at + duration
        heapq.heappush(self.landing, (at + duration, self.n, key, ok))
        return "miss", len(self.entries)


class Slots:
    """A queue before a number of slots, first come first served: when each request starts."""

    def __init__(self, slots: int = rules.SLOTS):
        self.free = [-(2**62)] * slots

    def __call__(self, at: int, duration: int) -> tuple[int, int]:
        start = max(at, heapq.heappop(self.free))
        heapq.heappush(self.free, start + duration)
        return start, start - at


def rate_limit(log: DataFrame, key: str, at: str, order: list[str], limit: int = rules.RATE_LIMIT, window: int = rules.RATE_WINDOW_MS) -> DataFrame:
    return in_order(log, [key], [at, *order], [at], lambda: RateLimiter(limit, window), "accepted boolean")


def cool_down(log: DataFrame, key: str, at: str, challenged: str, order: list[str], length: int = rules.COOLDOWN_MS) -> DataFrame:
    return in_order(log, [key], [at, *order], [at, challenged], lambda: CoolDown(length), "outcome string")


def single_flight(log: DataFrame, key: str, request: str, at: str, duration: str) -> DataFrame:
    """Adds ``leader`` and ``leader_id``; followers get the leader's result."""
    return in_order(log, [key], [at, request], [request, at, duration], SingleFlight, "leader boolean, leader_id bigint")


def cache(log: DataFrame, instance: str, key: str, request: str, at: str, duration: str, ttl: int = rules.CACHE_TTL_MS, most: int = rules.CACHE_ENTRIES) -> DataFrame:
    """Adds ``outcome`` (hit, inflight, miss) and the number of entries then.  An instance's capacity is shared by its keys, so it is the unit."""
    return in_order(log, [instance], [at, request], [at, key, duration], lambda: Cache(ttl, most), "outcome string, entries bigint")


def queue(log: DataFrame, pool: str, request: str, at: str, duration: str, slots: int = rules.SLOTS) -> DataFrame:
    return in_order(log, [pool], [at, request], [at, duration], lambda: Slots(slots), "start bigint, waited bigint")
