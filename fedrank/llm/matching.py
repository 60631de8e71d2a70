"""Repeated passages: candidate search by anchors, and the way back from matches to documents.

Both substring operators run in the same steps, each of which reads what the
last one stored in the shared folder, so a lost executor costs a task and not
the run:

1. ``screen`` - every document gives anchors (hash, doc_id, place).  Anchors that
   are seen twice within one task are candidates at once; of each hash one row
   goes on, so a hash that a third of all documents hold costs a row a task.
2. ``with_text`` - candidates meet the texts of the documents that have some.  A
   bitmap of at most 8 MB keeps other documents' texts out of the shuffle.
3. The operator looks for matches among candidates (rows of ``bucket, payload``).
4. ``with_text`` again, with the matched spans; documents without any never move.

Rows are packed: one Spark row carries numpy columns of thousands of small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import ragged, shared
from .ragged import U64

PACKED = "bucket long, payload binary"
#: Rows that a task gathers before it folds and sends them.
FLUSH_ROWS = 1_000_000
#: Documents to a bucket in the steps that bring texts and spans together.
BUCKET_DOCS = 500
BUCKET_BYTES = 2 << 20
SIEVE_BITS = 1 << 26
Columns = list[np.ndarray]


def pack(cols: Columns) -> bytes:
    """Columns as bytes; each is kept whole, as columns compress better than rows."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in cols)


def unpack(raw: bytes, kinds: str) -> Columns:
    """kinds: numpy types, separated by blanks.  Bytes after the columns, if any, are the tail of variable length: ``n`` rows then come first as 8 bytes."""
    types = [np.dtype(k) for k in kinds.split()]
    n, at, out = len(raw) // sum(t.itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * t.itemsize
    return out


def dealt(bucket: np.ndarray, cols: Columns) -> Iterator[tuple[int, Columns]]:
    """The rows of each bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(bucket[a]), [c[a:z] for c in cols]


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], ["bucket", "payload"])


def buckets_of(values: np.ndarray, n: int) -> np.ndarray:
    return (ragged.mix(values.astype(np.int64).view(U64)) % U64(n)).astype(np.int64)


def doc_rows(docs: np.ndarray, cols: Columns, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows about documents, packed by the documents' bucket."""
    rows = [(b, pack(c)) for b, c in dealt(buckets_of(docs, n_buckets), [docs, *cols])]
    for a in range(0, len(rows), 4096):
        yield packed_batch(rows[a : a + 4096])


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The payloads of each bucket, from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, p in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(p)
    if held:
        yield now, held


def grouped(packed: DataFrame, run: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str = PACKED) -> DataFrame:
    """Applies ``run`` to each bucket's payloads; a task holds one bucket at a time."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, payloads in by_bucket(batches):
            yield from run(bucket, payloads)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, schema)


ANCHOR = "<u8 <i8 <u4 <u4"
#: Buckets of direct candidates are kept apart from those of anchors.
DIRECT = 1 << 40


def screen(docs: DataFrame, anchors: Callable[[ragged.Block], tuple[np.ndarray, np.ndarray, np.ndarray]], across: bool, n_buckets: int, n_doc_buckets: int) -> DataFrame:
    """Places (``doc_id``, ``place``) whose anchor occurs twice, in two documents if ``across``; packed by document bucket, types ``<i8 <u4``.

    ``anchors`` gives hashes, the row of the block they are in, and places.  Rows with bucket -1 hold anchors' hashes and
    counts where a hash is frequent (types ``<u8 <i8``), at least 1/100 of the documents.
    """

    def send(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((place, doc, h))
        h, doc, place = h[order], doc[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([first, [len(h)]]))
        last = first + size - 1
        many = (doc[first] != doc[last]) if across else size > 1
        every = np.repeat(many, size)
        for b, c in dealt(buckets_of(doc[every], n_doc_buckets), [doc[every], place[every]]):
            yield b + DIRECT, pack(c)
        keep = ~every
        keep[first] = True
        count = np.ones(len(h), np.int64)
        count[first[many]] = size[many] + (1 << 31)
        h, doc, place, count = h[keep], doc[keep], place[keep], count[keep]
        for b, c in dealt((ragged.mix(h) % U64(n_buckets)).astype(np.int64), [h, doc, place, count.astype(np.uint32)]):
            yield b, pack(c)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(send(*(np.concatenate(c) for c in zip(*held, strict=True))))
            for a in range(0, len(rows), 4096):
                yield packed_batch(rows[a : a + 4096])

        for part in ragged.blocks(batches):
            h, row, place = anchors(part)
            if len(h):
                held.append((h, part.ids[row], place.astype(np.uint32)))
                n += len(h)
            if n >= FLUSH_ROWS:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    hot_from = max(2000, n_doc_buckets * BUCKET_DOCS // 100)

    def meet(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket >= DIRECT:
            yield packed_batch([(bucket - DIRECT, p) for p in payloads])
            return
        h, doc, place, count = (np.concatenate(c) for c in zip(*(unpack(p, ANCHOR) for p in payloads), strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, place, count = h[order], doc[order], place[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([first, [len(h)]]))
        known = count >= 1 << 31
        if across:
            many = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | np.maximum.reduceat(known, first)
        else:
            many = (size > 1) | np.maximum.reduceat(known, first)
        new = np.repeat(many, size) & ~known
        yield from doc_rows(doc[new], [place[new]], n_doc_buckets)
        total = np.add.reduceat(count.astype(np.int64) & (2**31 - 1), first)
        hot = total >= hot_from
        if hot.any():
            yield packed_batch([(-1, pack([h[first[hot]], total[hot]]))])

    found = ragged.documents(docs).mapInArrow(lambda it: find(it), PACKED)
    return shared.stored(grouped(found, meet), "candidates")


def extent(docs: DataFrame) -> tuple[int, int]:
    """How many documents there are, and how many buckets for anchors: one for each BUCKET_BYTES of text, or more where the
    session has more partitions."""
    size = ragged.documents(docs).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return size.n, max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size.bytes // BUCKET_BYTES)


def doc_buckets(n_docs: int) -> int:
    return max(64, -(-n_docs // BUCKET_DOCS))


class Sieve:
    """A bitmap of identifiers that may say yes too often, never no too often.  It has 16 bits a document, up to 8 MB in all."""

    def __init__(self, packed: DataFrame, kinds: str, n_docs: int):
        self.bits = min(SIEVE_BITS, max(1 << 15, 1 << int(16 * n_docs).bit_length()))
        bits, slot = self.bits, self.slot

        def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw = np.zeros((bits >> 15, 4096), np.uint8)
            for batch in batches:
                for p in batch.column("payload").to_pylist():
                    at = slot(unpack(p, kinds)[0], bits)
                    np.bitwise_or.at(raw.reshape(-1), at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            some = np.flatnonzero(raw.any(1))
            for a in range(0, len(some), 256):
                yield packed_batch([(int(k), raw[k].tobytes()) for k in some[a : a + 256]])

        parts = packed.where("bucket >= 0").mapInArrow(mark, PACKED).groupBy("bucket").agg(F.bitmap_or_agg("payload").alias("payload"))
        whole = np.zeros((bits // 32768, 4096), np.uint8)
        for r in parts.collect():
            whole[r.bucket] = np.frombuffer(r.payload, np.uint8)
        self.shared = packed.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    @staticmethod
    def slot(ids: np.ndarray, bits: int) -> np.ndarray:
        return (ragged.mix(ids.astype(np.int64).view(U64)) & U64(bits - 1)).astype(np.int64)

    def tester(self) -> Callable[[np.ndarray], np.ndarray]:
        bits, slot, held = self.bits, self.slot, self.shared

        def test(ids: np.ndarray) -> np.ndarray:
            at = slot(ids, bits)
            return (held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        return test


def marked(docs: DataFrame, sieve: Sieve, n_doc_buckets: int, carry: list[str] | None = None) -> DataFrame:
    """``bucket, doc_id, text`` of the documents that pass the sieve."""
    test = sieve.tester()
    docs = ragged.documents(docs, carry)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            keep = test(ids)
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([pa.array(buckets_of(ids[keep], n_doc_buckets)), *(part.column(c) for c in names)], ["bucket", *names])

    return docs.mapInArrow(run, "bucket long, " + fields(docs))


def fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def carried(batch: pa.RecordBatch, out: list[pa.RecordBatch], carry: list[str]) -> list[pa.RecordBatch]:
    """``out``, made of the batch's rows in their order, with the columns to carry."""
    if not carry or not out:
        return out
    whole = pa.Table.from_batches(out)
    for c in carry:
        whole = whole.append_column(c, batch.column(c))
    return whole.combine_chunks().to_batches()


def with_text(
    texts: DataFrame, packed: DataFrame, kinds: str, run: Callable[[ragged.Block, Columns], Iterator[pa.RecordBatch]], schema: str, carry: list[str] | None = None
) -> DataFrame:
    """Applies ``run`` to each bucket of documents and the packed rows about them, which come sorted by doc_id.

    With ``carry``, ``run`` must give a row for each document, in their order.
    """
    schema += "".join(f", `{c}` {texts.schema[c].dataType.simpleString()}" for c in carry or [])

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*(unpack(p, kinds) for p in right.column("payload").to_pylist()), strict=True)] or [np.zeros(0, k) for k in kinds.split()]
        order = np.lexsort(tuple(reversed(cols)))
        cols = [c[order] for c in cols]
        out = []
        for batch in left.combine_chunks().to_batches():
            out += carried(batch, [x for block in ragged.blocks([batch]) for x in run(block, cols)], carry or [])
        return pa.Table.from_batches(out, schema=arrow_schema) if out else arrow_schema.empty_table()

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return texts.groupBy("bucket").cogroup(packed.groupBy("bucket")).applyInArrow(each, schema)


def unmarked(docs: DataFrame, sieve: Sieve, run: Callable[[ragged.Block, None], Iterator[pa.RecordBatch]], schema: str, carry: list[str] | None = None) -> DataFrame:
    """Applies ``run``, which gives a row for each document, to the documents that don't pass the sieve.  One Python stage."""
    test = sieve.tester()
    docs = ragged.documents(docs, carry)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~test(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))))
            yield from carried(part, [x for block in ragged.blocks([part]) for x in run(block, None)], carry or [])

    return docs.mapInArrow(each, schema + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry or []))


def rows_of(block: ragged.Block, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document of the block, which of the rows sorted by ``docs`` are about it: pairs (row of block, index), flat."""
    a, z = np.searchsorted(docs, block.ids, "left"), np.searchsorted(docs, block.ids, "right")
    return np.repeat(np.arange(len(block.ids)), z - a), ragged.spread(a, z - a)
