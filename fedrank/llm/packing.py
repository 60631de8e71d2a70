"""Cost-balanced packing of documents into training sequences of fixed length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe, ragged, tokens

#: Ids of blocks' sequences begin at partition << SHIFT.
SHIFT = 36


def assign(lengths: np.ndarray, limit: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with ``lengths`` tokens.

    A full ``limit`` of tokens is a sequence of its own.  What is left of the documents, by descending estimated cost
    (``linear * n + quadratic * n * n``), goes to the sequence of lowest cost that can hold it; if none can, the part that
    fits goes to the emptiest.  Only one sequence in all is left with room.
    """
    out = []
    full, rest = np.divmod(lengths, limit)
    n_full = int(full.sum())
    for k in np.flatnonzero(full).tolist():
        base = len(out)
        out += [(k, j * limit, limit, base + j, 0) for j in range(int(full[k]))]
    count = -(-int(rest.sum()) // limit)
    cost, room = np.zeros(count), np.full(count, limit, np.int64)

    def put(k: int, start: int, n: int, seq: int) -> None:
        out.append((k, start, n, n_full + seq, limit - int(room[seq])))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    for k in sorted(np.flatnonzero(rest).tolist(), key=lambda k: (-int(rest[k]), k)):
        start, n = int(full[k]) * limit, int(rest[k])
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                put(k, start, n, int(fits[np.argmin(cost[fits])]))
                break
            widest = int(np.argmax(room))
            part = int(room[widest])
            put(k, start, part, widest)
            start, n = start + part, n - part
    return out


def pack(docs: DataFrame, path: str, limit: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, end_id: int = 0) -> DataFrame:
    """Packs every document's ids, with ``end_id`` after them, into sequences of at most ``limit`` tokens.

    Documents are packed in blocks of about 1 MB of text within the partition that reads them: there is no shuffle, memory
    is bounded by a block, and a block leaves one sequence with padding at most.  A partition's sequences are numbered from
    its number times 2**36, so a task that runs again gives the same rows.

    Returns a row for each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (binary, unsigned
    little-endian 32-bit).  Null and empty texts are one token, ``end_id``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = bpe.cache(path, "library"), TaskContext.get().partitionId() << SHIFT
        for block in ragged.blocks(batches, tokens.PIECE_BLOCK):
            ids, n = tokens.token_ids(block, coder)
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            n, first = n + 1, ends - n + np.arange(len(n))
            pieces = np.array(assign(n, limit, linear, quadratic), np.int64).reshape(-1, 5)
            k, start, length, seq, offset = pieces.T
            a = first[k] + start
            raw = [ids[x:y].tobytes() for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
            cols = [block.ids[k], start, length, n[k], base + seq, offset]
            base += int(seq.max()) + 1
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(raw, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ragged.documents(docs).mapInArrow(run, schema)
