"""Vectorised primitives on ragged byte data held in flat numpy arrays.

A *block* is a slice of an Arrow batch: the documents' UTF-8 bytes, one after
another, with their offsets.  All functions work on whole blocks, so Python
cost is per block and not per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Two odd multipliers, each with a table of random byte values: independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A little less than a power of two, up to which tables of powers are made.
BLOCK_BYTES = (1 << 20) - 64

#: Bytes between words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def documents(df: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The two columns every operator reads, in the shape it expects, and those named in ``carry``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text, *(carry or [])).where(F.col("doc_id").isNotNull())


@dataclass
class Block:
    ids: np.ndarray
    data: np.ndarray
    offs: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.offs[k] : self.offs[k + 1]].tobytes()


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def _libc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        return None


_TRIM = _libc_trim()


def release() -> None:
    """Gives memory that is free back to the system, as idle workers would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``size`` bytes; one document is never split, so a longer one makes a block alone."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        data, offs = string_buffers(batch.column("text"))
        a, n = 0, len(ids)
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
            yield Block(ids[a:b], data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            a = b
        del ids, data, offs, batch
        release()


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as needed."""

    def __init__(self, base: int, seed: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.byte = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << max(20, (n - 1).bit_length())
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (self.base, self.inv))


POWERS = tuple(Powers(b, 7 + k) for k, b in enumerate(BASES))


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which span() takes the hash of any run of ``values``; uint8 is looked up in a table of random numbers first."""
    p = POWERS[which]
    p.need(len(values) + 1)
    v = p.byte[values] if values.dtype == np.uint8 else values
    out = np.empty(len(v) + 1, U64)
    out[0] = 0
    np.cumsum(v * p.up[: len(v)], out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return (pre[end] - pre[start]) * POWERS[which].down[start]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits; one to one."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lens[0]-1, starts[1] .. and so on."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def gather(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return data[spread(starts, lens)]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the index of each text's first word (one more entry than texts)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts texts where any byte-level pre-tokeniser of this family cuts too: before white space that follows a character
    which surely is none.  Gives the pieces' starts and ends; their tokens, one after another, are those of the text.

    A character is surely none if it is printable ASCII or one of two bytes from U+00C0 on; after others there is no cut,
    which only makes a piece longer.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        safe = (data > 0x20) & (data < 0x7F)
        safe[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        cut[1:n] = SPACE[data[1:]] & safe[:-1]
    cut[offs] = True
    cut[n] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def dedupe(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each group of equal 64-bit values, and for each value the number of its group; by hashing, in linear time."""
    n = len(h)
    bits = max(8, int(n).bit_length())
    table, first, todo = np.empty(1 << bits, np.int64), np.empty(n, np.int64), np.arange(n)
    turn = 0
    while len(todo):
        slot = ((h[todo] * U64(0x9E3779B97F4A7C15 + 2 * turn)) >> U64(64 - bits)).astype(np.int64)
        table[slot[::-1]] = todo[::-1]
        got = table[slot]
        same = h[got] == h[todo]
        first[todo[same]] = got[same]
        todo, turn = todo[~same], turn + 1
    rep = np.flatnonzero(first == np.arange(n))
    number = np.empty(n, np.int64)
    number[rep] = np.arange(len(rep))
    return rep, number[first]


def fold(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each group of equal pieces, and for each piece the number of its group.  Bytes are compared, not only hashes."""
    if len(starts) == 0:
        z = np.zeros(0, np.int64)
        return z, z
    lens = ends - starts
    pre = prefix(data)
    rep, inv = dedupe(mix(span(pre, starts, ends) + lens.astype(U64)))
    other = np.flatnonzero(rep[inv] != np.arange(len(inv)))
    to = rep[inv[other]]
    same = np.array_equal(lens[other], lens[to]) and np.array_equal(gather(data, starts[other], lens[other]), gather(data, starts[to], lens[to]))
    if not same:  # two pieces share a hash
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        inv = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        rep = np.unique(inv, return_index=True)[1]
    return rep, inv


def by_text(starts: np.ndarray, offs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values``, one for each piece, for each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.searchsorted(starts, offs)])


def unmasked_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    if len(mask) == 0:
        z = np.zeros(0, np.int64)
        return z, z
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
