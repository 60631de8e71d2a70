"""Shared word windows across documents, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import matching, ragged, shared
from .ragged import U64

#: A difference cover modulo 31: every residue is a difference of two of these, so any two places have a common shift below
#: 31 that brings both to a cover place.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)


class Words:
    """The words of a block, with two hashes each, and places counted within each text."""

    def __init__(self, block: ragged.Block):
        self.start, self.end, self.first = ragged.words(block.data, block.offs)
        n = np.diff(self.first)
        self.count, self.row = n, np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.start)) - self.first[self.row]
        self.left = n[self.row] - self.place  # words from here to the text's end
        size = (self.end - self.start).astype(U64)
        self.prefix = tuple(ragged.prefix(ragged.mix(ragged.span(ragged.prefix(block.data, k), self.start, self.end, k) + size), k) for k in (0, 1))

    def hashes(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        return ragged.mix(ragged.span(self.prefix[which], at, at + n, which))


def cover_anchors(width: int, length: int):
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(block: ragged.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = Words(block)
        at = np.flatnonzero(in_cover[w.place % PERIOD] & (w.left >= length) & (w.count[w.row] >= width))
        return w.hashes(at, length), w.row[at], w.place[at]

    return anchors


WINDOW = "<u8 <u8 <i8 <u4"


def remove_shared_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """Removes each word that lies in a window of ``width`` words which also starts in a document with a smaller doc_id.

    Anchors of ``width - 30`` words are hashed at places that fall in a difference cover modulo 31.  Two equal windows have a
    shift at which both hold an aligned anchor, so only windows over a repeated anchor can match; these are extended to the
    full width and compared by a 128-bit hash of all their words.  Windows are judged on the input.

    Returns ``doc_id, n_words, n_removed, text``: the words that stay, joined by one blank.  Null, empty and short texts lose
    nothing.  Rows with equal doc_id count as one document: they lose what smaller doc_ids hold.
    """
    length = width - PERIOD + 1
    n_docs, n_buckets = matching.extent(docs)
    n_doc_buckets = matching.doc_buckets(n_docs)
    shared.small_batches(docs.sparkSession)
    candidates = matching.screen(docs, cover_anchors(width, length), True, n_buckets, n_doc_buckets)
    sieve = matching.Sieve(candidates, "<i8 <u4", n_docs)

    def extend(block: ragged.Block, cols: matching.Columns) -> Iterator[pa.RecordBatch]:
        row, index = matching.rows_of(block, cols[0])
        if not len(row):
            return
        w = Words(block)
        hit = np.zeros(len(w.start) + 1, np.int64)
        at = w.first[row] + cols[1][index]
        hit[at[at < w.first[row + 1]] + 1] = 1
        total = np.cumsum(hit)
        s = np.flatnonzero(w.left >= width)
        s = s[total[s + PERIOD] > total[s]]
        h, g, doc, place = w.hashes(s, width), w.hashes(s, width, 1), block.ids[w.row[s]], w.place[s].astype(np.uint32)
        order = np.lexsort((doc, g, h))
        h, g, doc, place = h[order], g[order], doc[order], place[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])[: len(h)]
        least = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = doc > least
        for b, c in matching.dealt(matching.buckets_of(doc[again], n_doc_buckets), [doc[again], place[again]]):
            yield matching.packed_batch([(b + matching.DIRECT, matching.pack(c))])
        h, g, doc, place = (x[~again] for x in (h, g, doc, place))
        rows = [(b, matching.pack(c)) for b, c in matching.dealt((h % U64(n_buckets)).astype(np.int64), [h, g, doc, place])]
        yield matching.packed_batch(rows)

    def settle(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket >= matching.DIRECT:
            yield matching.packed_batch([(bucket - matching.DIRECT, p) for p in payloads])
            return
        h, g, doc, place = (np.concatenate(c) for c in zip(*(matching.unpack(p, WINDOW) for p in payloads), strict=True))
        order = np.lexsort((doc, g, h))
        h, g, doc, place = h[order], g[order], doc[order], place[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        again = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        yield from matching.doc_rows(doc[again], [place[again]], n_doc_buckets)

    texts = matching.marked(docs, sieve, n_doc_buckets)
    windows = matching.with_text(texts, candidates.where("bucket >= 0"), "<i8 <u4", extend, matching.PACKED)
    matches = shared.stored(matching.grouped(windows, settle), "matches")
    found = matching.Sieve(matches, "<i8 <u4", n_docs)

    def result(block: ragged.Block, cols: matching.Columns | None) -> Iterator[pa.RecordBatch]:
        w = Words(block)
        gone = np.zeros(len(w.start) + 1, np.int64)
        if cols is not None:
            row, index = matching.rows_of(block, cols[0])
            at = w.first[row] + cols[1][index]
            at = at[at + width <= w.first[row + 1]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + width, -1)
        keep = np.cumsum(gone)[:-1] == 0
        a, z, row = w.start[keep], w.end[keep], w.row[keep]
        raw = ragged.gather(np.append(block.data, np.uint8(32)), a, z - a + 1)
        ends = np.cumsum(z - a + 1)
        raw[ends - 1] = 32
        ends = np.concatenate([[0], ends])
        cut = np.searchsorted(row, np.arange(len(block.ids) + 1))
        flat = raw.tobytes()
        texts = [flat[x:y - 1].decode() if y > x else "" for x, y in zip(ends[cut[:-1]].tolist(), ends[cut[1:]].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(w.count), pa.array(w.count - np.diff(cut)), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    schema = "doc_id long, n_words long, n_removed long, text string"

    changed = matching.with_text(matching.marked(docs, found, n_doc_buckets), matches, "<i8 <u4", result, schema)
    return matching.unmarked(docs, found, result, schema).unionByName(changed)
