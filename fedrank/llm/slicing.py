"""Numbers in slices: tasks send sorted columns cut by bucket, buckets merge them and reply in the same order, without keys."""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ragged import U64

SLICE = "bucket long, chunk long, payload binary"
REPLY = "chunk long, bucket long, payload binary"
KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def press(*cols: np.ndarray) -> bytes:
    """Columns of numbers, compressed byte plane by byte plane; integers in as few bytes as their largest needs."""
    out = []
    for c in cols:
        if c.dtype.kind != "f":
            c = c.astype(np.min_scalar_type(int(c.max(initial=0))))
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T
        raw = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
        out += [struct.pack("<cBII", c.dtype.kind.encode(), c.itemsize, len(c), len(raw)), raw]
    return b"".join(out)


def unpress(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, size, n, length = struct.unpack_from("<cBII", raw, at)
        at += 10
        planes = np.frombuffer(pa.decompress(raw[at : at + length], n * size, codec="zstd", asbytes=True), np.uint8)
        c = np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(f"<{kind.decode()}{size}")
        out.append(c if kind == b"f" else c.astype(np.int64 if size < 8 else U64))
        at += length
    return out


def steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=U64(0))


def unsteps(diffs: np.ndarray) -> np.ndarray:
    return np.cumsum(diffs.astype(U64), dtype=U64)


def unsigned(ids: np.ndarray) -> np.ndarray:
    """Identifiers of either sign as small numbers without one."""
    return (ids << 1 ^ ids >> 63).view(U64)


def signed(ids: np.ndarray) -> np.ndarray:
    ids = ids.astype(U64)
    return (ids >> U64(1)).astype(np.int64) ^ -(ids & U64(1)).astype(np.int64)


@functools.cache
def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([pa.field(name, KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def rows(schema: str, *cols: list | np.ndarray) -> pa.RecordBatch:
    arrow = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def bucket_of(h: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Ranges of hashes: buckets rise with them."""
    return ((h >> U64(bits - 32)) * U64(n) >> U64(32)).astype(np.int64)


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket of a sorted array, with where its slice begins and ends."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(bucket[a]), a, z


def sliced(chunk: int, bucket: np.ndarray, pack: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """A chunk's slices for all buckets."""
    out = [(b, pack(a, z)) for b, a, z in slices(bucket)]
    return rows(SLICE, [b for b, _ in out], [chunk] * len(out), [p for _, p in out])


def cuts(size: np.ndarray) -> list[tuple[int, int]]:
    """Where parts of the given sizes begin and end."""
    end = np.cumsum(size)
    return list(zip((end - size).tolist(), end.tolist(), strict=True))


def merged(parts: DataFrame, run: Callable[[int, list[int], list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies ``run`` to the slices of each bucket, in the order of their chunks."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, held = None, [], []
        for b, c, p in listed(batches):
            if b != now and held:
                yield from run(now, chunk, held)
                chunk, held = [], []
            now = b
            chunk.append(c)
            held.append(p)
        if held:
            yield from run(now, chunk, held)

    return parts.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(each, schema)


def together(left: DataFrame, right: DataFrame, key: str, run: Callable[[dict, list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies ``run`` to each row of ``left``, one a key, and the rows of ``right``."""

    def each(a: pa.Table, b: pa.Table) -> pa.Table:
        found = a.to_pylist()
        return pa.Table.from_batches([run(found[0], b.to_pylist())]) if found else arrow_schema(schema).empty_table()

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(each, schema)


def union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, frames)


def joined(found: list[dict]) -> list[np.ndarray]:
    """Replies of all buckets as columns."""
    return [np.concatenate(c) for c in zip(*(unpress(r["payload"]) for r in sorted(found, key=lambda r: r["bucket"])), strict=True)]
