"""Repeated byte strings, by suffix arrays of the stretches that can hold any.

Suffix order comes from two-stage sorting: only suffixes smaller than their
successor are sorted directly; each other one is put in place by scanning the
buckets of first bytes in order, right after the place of its successor is
known.  Common prefixes of neighbours then show which windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching, ragged, shared
from .ragged import U64

#: Text of the stretches that one suffix array covers, unless one anchor alone has more.
ARRAY_BYTES = 1 << 20


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` places of ``text`` (uint8) in the order of their suffixes' first ``depth`` bytes.  Behind the text are zeros.

    Besides the wanted suffixes only those are sorted that they are induced from.
    """
    n = len(text)
    if not len(wanted):
        return wanted
    width = -(-depth // 8) * 8
    padded = np.concatenate([text, np.zeros(width + 1, np.uint8)])
    rise = padded[1:].astype(np.int16) - padded[:-1]
    change = np.where(rise != 0, np.arange(len(rise)), len(rise))
    change = np.minimum.accumulate(change[::-1])[::-1]  # where a run of equal bytes ends
    smaller = np.append(rise, 1)[change][: n + 1] > 0  # than its successor
    # a larger suffix needs its successor, and so on to the next smaller one
    stop = np.minimum.accumulate(np.where(smaller, np.arange(n + 1), n)[::-1])[::-1]
    smaller[n] = True
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, wanted, 1)
    np.add.at(edge, stop[wanted] + 1, -1)
    needed = np.cumsum(edge)[: n + 1] > 0
    direct = np.flatnonzero(needed & smaller)
    keys = np.lib.stride_tricks.sliding_window_view(padded, width)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{width}").ravel(), kind="stable")]
    induced = needed & ~smaller
    first = padded[direct]
    cut = np.searchsorted(first, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        bucket, wave = [part], part
        while len(wave):  # successors in the same bucket
            wave = wave[wave > 0] - 1
            wave = wave[induced[wave] & (padded[wave] == c)]
            bucket.append(wave)
        bucket.append(direct[cut[c] : cut[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[induced[before]]
        byte = padded[before]
        before, byte = before[byte > c], byte[byte > c]
        for b, (rows,) in matching.dealt(byte, [before]):
            pending[b].append(rows)
    order = np.concatenate(out)
    asked = np.zeros(n + 1, bool)
    asked[wanted] = True
    return order[asked[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes, up to ``depth``, each suffix but the first shares with the one before it in ``order``."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.zeros(max(0, len(order) - 1), np.int64)
    for a in range(0, len(out), 1 << 16):
        keys = view[order[a : a + (1 << 16) + 1]]
        differ = keys[1:] != keys[:-1]
        out[a : a + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


class Runs:
    """The windows of a block's texts, cut into runs that share their anchor.

    A window of ``width`` bytes holds ``width - gram + 1`` grams; its anchor is the first of those with the least hash, which
    depends on the window's bytes only.
    """

    def __init__(self, block: ragged.Block, width: int, gram: int):
        size = np.diff(block.offs)
        grams = width - gram + 1
        n = len(block.data) - width + 1
        z = np.zeros(0, np.int64)
        self.start = self.length = self.row = z
        self.hash = np.zeros(0, U64)
        if n <= 0:
            return
        pre = ragged.prefix(block.data)
        at = np.arange(len(block.data) - gram + 1)
        hashes = ragged.mix(ragged.span(pre, at, at + gram))
        value, where, span = hashes, at.astype(np.int32), 1
        while span < grams:
            step = min(span, grams - span)
            later = value[step:] < value[:-step]
            where = np.where(later, where[step:], where[:-step])
            value = np.where(later, value[step:], value[:-step])
            span += step
        inside = np.zeros(len(block.data) + 1, np.int8)
        some = size >= width
        np.add.at(inside, block.offs[:-1][some], 1)
        np.add.at(inside, block.offs[1:][some] - width + 1, -1)
        inside = np.cumsum(inside)[:n] > 0
        starts_text = np.zeros(n, bool)
        starts_text[block.offs[:-1][some]] = True
        new = inside.copy()
        new[1:] &= (where[1:n] != where[: n - 1]) | ~inside[:-1] | starts_text[1:]
        self.start = np.flatnonzero(new)
        after = np.append(self.start[1:], n)
        total = np.concatenate([[0], np.cumsum(inside)])
        self.length = total[after] - total[self.start]
        self.hash = hashes[where[self.start]]
        self.row = np.searchsorted(block.offs, self.start, "right") - 1


def window_groups(text: np.ndarray, frag: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the fragments, which start at ``frag`` and have ``length`` windows: its place, and whether an equal
    window belongs to an earlier fragment or place."""
    wanted = ragged.spread(frag, length)
    order = two_stage_sort(text, wanted, width)
    group = np.concatenate([[0], np.cumsum(common_prefixes(text, order, width) < width)])
    least = np.full(group[-1] + 1, len(text), np.int64)
    np.minimum.at(least, group, order)
    return order, least[group] < order


FRAGMENT = "<u8 <i8 <u4 <u4"


def pack_fragments(cols: matching.Columns, content: bytes) -> bytes:
    return len(cols[0]).to_bytes(8, "little") + matching.pack(cols) + content


def unpack_fragments(raw: bytes) -> tuple[matching.Columns, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    end = 8 + n * sum(np.dtype(k).itemsize for k in FRAGMENT.split())
    return matching.unpack(raw[8:end], FRAGMENT), np.frombuffer(raw, np.uint8, offset=end)


def remove_repeats(docs: DataFrame, width: int = 100, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Removes each byte covered by a string of ``width`` bytes that also starts earlier: in a smaller doc_id, or before in the same document.

    Strings are judged on the input; matches never cross documents.  Windows with one anchor form a run; a run whose anchor
    occurs once in the corpus holds no repeat.  The other runs' bytes are folded where they are equal, meet the runs with
    the same anchor, and there a suffix array shows which windows are equal.  Runs of frequent anchors are cut into single
    windows first, which are dealt by their own hash, so none is too much for a task.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary): spans are maximal runs of removed bytes.  Null and empty
    texts have no bytes.  Rows with equal doc_id count as one document: they don't remove each other.
    Columns named in ``carry`` come along.  With ``as_text`` what is kept is a column ``text``, without characters that were
    removed in part.
    """
    carry = carry or []
    gram = width // 2 + 1
    n_docs, n_buckets = matching.extent(docs)
    n_doc_buckets = matching.doc_buckets(n_docs)
    shared.small_batches(docs.sparkSession)

    def anchors(block: ragged.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = Runs(block, width, gram)
        return runs.hash, runs.row, runs.start - block.offs[runs.row]

    candidates = matching.screen(docs, anchors, False, n_buckets, n_doc_buckets)
    sieve = matching.Sieve(candidates, "<i8 <u4", n_docs)
    frequent = [matching.unpack(r.payload, "<u8 <i8")[0] for r in candidates.where("bucket = -1").select("payload").collect()]
    hot = np.unique(np.concatenate([np.zeros(0, U64), *frequent]))

    def spans_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, direct: int) -> Iterator[tuple[int, bytes]]:
        for b, c in matching.dealt(matching.buckets_of(doc, n_doc_buckets), [doc, start.astype(np.uint32), end.astype(np.uint32)]):
            yield b + direct, matching.pack(c)

    def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> matching.Columns:
        """Spans of equal length, joined where they overlap or touch."""
        if not len(doc):
            return [doc, start, end]
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
        first = np.flatnonzero(new)
        return [doc[first], start[first], np.maximum.reduceat(end, first)]

    def repeated(doc: np.ndarray, place: np.ndarray, data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Which fragments, in the order that counts, equal an earlier one at another place; a document may be there twice."""
        rep, inv = ragged.fold(data, a, z)
        first = rep[inv]
        return (doc[first] != doc) | (place[first] != place)

    def fragments(block: ragged.Block, cols: matching.Columns) -> Iterator[pa.RecordBatch]:
        row, index = matching.rows_of(block, cols[0])
        if not len(row):
            return
        runs = Runs(block, width, gram)
        chosen = np.zeros(len(block.data) + 1, bool)
        at = block.offs[row] + cols[1][index]
        chosen[at[at < block.offs[row + 1]]] = True
        pick = np.flatnonzero(chosen[runs.start])
        a, n, key, r = runs.start[pick], runs.length[pick], runs.hash[pick], runs.row[pick]
        cut = np.isin(key, hot)
        if cut.any():
            single = ragged.spread(a[cut], n[cut])
            own = ragged.mix(ragged.span(ragged.prefix(block.data, 1), single, single + width, 1))
            a, key, r = np.concatenate([a[~cut], single]), np.concatenate([key[~cut], own]), np.concatenate([r[~cut], np.repeat(r[cut], n[cut])])
            n = np.concatenate([n[~cut], np.ones(len(single), np.int64)])
        doc, place = block.ids[r], a - block.offs[r]
        order = np.lexsort((place, doc))
        a, n, key, doc, place = a[order], n[order], key[order], doc[order], place[order]
        again = repeated(doc, place, block.data, a, a + n + width - 1)
        rows = list(spans_rows(*merged(doc[again], place[again], place[again] + n[again] + width - 1), matching.DIRECT))
        keep = ~again
        a, n, key, doc, place = a[keep], n[keep], key[keep], doc[keep], place[keep]
        for b, (key, doc, place, n, a) in matching.dealt((key % U64(n_buckets)).astype(np.int64), [key, doc, place, n, a]):
            rows.append((b, pack_fragments([key, doc, place.astype(np.uint32), n.astype(np.uint32)], ragged.gather(block.data, a, n + width - 1).tobytes())))
        yield matching.packed_batch(rows)

    def settle(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket >= matching.DIRECT:
            yield matching.packed_batch([(bucket - matching.DIRECT, p) for p in payloads])
            return
        parts = [unpack_fragments(p) for p in payloads]
        key, doc, place, n = (np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True))
        data = np.concatenate([p[1] for p in parts])
        size = n.astype(np.int64) + width - 1
        a = np.cumsum(size) - size
        order = np.lexsort((place, doc, key))
        key, doc, place, n, size, a = key[order], doc[order], place[order].astype(np.int64), n[order].astype(np.int64), size[order], a[order]
        group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(group[1:], len(key))
        found: list[matching.Columns] = []
        x = 0
        while x < len(group):  # whole groups of one anchor, as many as make a text of ARRAY_BYTES
            y, total = x, 0
            while y < len(group) and (y == x or total < ARRAY_BYTES):
                total += int(size[group[y] : ends[y]].sum())
                y += 1
            k = np.arange(group[x], ends[y - 1])
            x = y
            again = repeated(doc[k], place[k], data, a[k], a[k] + size[k])
            found.append([doc[k[again]], place[k[again]], place[k[again]] + size[k[again]]])
            k = k[~again]
            text = ragged.gather(data, a[k], size[k])
            frag = np.cumsum(size[k]) - size[k]
            where, earlier = window_groups(text, frag, n[k], width)
            where = np.sort(where[earlier])
            f = np.searchsorted(frag, where, "right") - 1
            start = place[k[f]] + where - frag[f]
            found.append([doc[k[f]], start, start + width])
        doc, start, end = merged(*(np.concatenate(c) for c in zip(*found, strict=True)))
        rows = list(spans_rows(doc, start, end, 0))
        if rows:
            yield matching.packed_batch(rows)

    texts = matching.marked(docs, sieve, n_doc_buckets)
    pieces = matching.with_text(texts, candidates.where("bucket >= 0"), "<i8 <u4", fragments, matching.PACKED)
    spans = shared.stored(matching.grouped(pieces, settle), "spans")
    found = matching.Sieve(spans, "<i8 <u4 <u4", n_docs)

    def result(block: ragged.Block, cols: matching.Columns | None) -> Iterator[pa.RecordBatch]:
        size = np.diff(block.offs)
        gone = np.zeros(len(block.data) + 1, np.int64)
        if cols is not None:
            row, index = matching.rows_of(block, cols[0])
            a, z = block.offs[row] + cols[1][index], block.offs[row] + cols[2][index]
            ok = z <= block.offs[row + 1]
            np.add.at(gone, a[ok], 1)
            np.add.at(gone, z[ok], -1)
        out = np.cumsum(gone)[:-1] > 0
        begins = out.copy()
        begins[1:] &= ~out[:-1]
        begins[block.offs[:-1][size > 0]] = out[block.offs[:-1][size > 0]]
        removed = np.diff(np.concatenate([[0], np.cumsum(out)])[block.offs])
        spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[block.offs])
        flat = block.data[~out].tobytes()
        cut = np.concatenate([[0], np.cumsum(size - removed)]).tolist()
        kept = [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        left = pa.array([raw.decode("utf-8", "ignore") for raw in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(size), pa.array(removed), pa.array(spans), left], ["doc_id", "n_bytes", "n_removed", "n_spans", "text" if as_text else "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("text string" if as_text else "kept binary")

    changed = matching.with_text(matching.marked(docs, found, n_doc_buckets, carry), spans, "<i8 <u4 <u4", result, schema, carry)
    return matching.unmarked(docs, found, result, schema, carry).unionByName(changed)


def deduplicate(docs: DataFrame, width: int = 100) -> DataFrame:
    """``docs``, all columns, with what remove_repeats() leaves of their texts, and n_chars, if there is one, counted anew.

    A character that is removed in part is removed.  Rows without doc_id go.
    """
    row = docs.select("doc_id", "text", F.struct("*").alias("row"))
    cut = remove_repeats(row, width, carry=["row"], as_text=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return cut.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
