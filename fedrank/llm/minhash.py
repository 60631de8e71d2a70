"""Near-duplicates by HyperMinHash: compressed registers, bands of them, and links confirmed on whole shingle sets.

1. Every text gives the set of its word shingles, a digest of the set, and 128
   registers: 8 hashes, each with 16 buckets, and of each bucket's least value the
   number of leading zeros and ten bits of mantissa.  Texts with equal sets are
   one class, so copies never meet each other.
2. Bands of four registers put classes into groups.  A group gives a star of
   links to try, not all its pairs.
3. Of groups whose members are still in several components, small ones try those
   pairs across components whose estimated similarity, corrected for chance
   agreement of registers, leaves a link possible.  Large ones try a second star,
   around the member nearest to the group's most common registers, and then
   all members across components by their differences from that hub.
4. Links are confirmed on whole sets, or by whole differences from one set.

Links between classes that are already connected need not be tried: components
are the same without them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, matching, ragged, shared
from .ragged import U64

HASHES, BUCKETS, MANTISSA = 8, 16, 10
REGISTERS = HASHES * BUCKETS
BAND = 4
#: Two different registers agree by chance with this probability: the sum of 4**-zeros, over the mantissas.
CHANCE = 1 / 3 / (1 << MANTISSA)
#: Standard deviations that an estimate may lie below the threshold.
MARGIN = 4.5
#: Members of a group that one task compares, and bytes of differences from a hub.
PART = 4096
PART_BYTES = 16 << 20
#: Classes whose bands are handled at a time, and rows of bands that a task gathers before it sends them.
SOME, STAR_ROWS = 1024, 1 << 17
#: Groups of at most so many members try pairs, larger ones differences from a hub.
FEW = 32


def shingle_sets(block: ragged.Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (lower-cased A-Z, words between ASCII white space): hashes, their text's row, and sizes."""
    data = ragged.LOWER[block.data]
    start, end, first = ragged.words(data, block.offs)
    n = np.diff(first)
    size = (end - start).astype(U64)
    pre = ragged.prefix(ragged.mix(ragged.mix(ragged.span(ragged.prefix(data), start, end) + size) + ragged.span(ragged.prefix(data, 1), start, end, 1)))
    row = np.repeat(np.arange(len(n)), n)
    left = n[row] - (np.arange(len(start)) - first[row])
    at = np.flatnonzero((left >= width) | ((left == n[row]) & (n[row] < width)))
    row = row[at]
    h = ragged.mix(ragged.span(pre, at, at + np.minimum(left[at], width)) + np.minimum(left[at], width).astype(U64))
    rep, _ = ragged.dedupe(ragged.mix(h + ragged.mix(row.astype(U64))))
    h, row = h[rep], row[rep]
    return h, row, np.bincount(row, minlength=len(n))


def registers(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The registers of each of ``n`` sets, 0 where a bucket is empty."""
    out = np.zeros((n, HASHES, BUCKETS), np.uint16)
    for k in range(HASHES):
        g = ragged.mix(h + U64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)))
        least = np.full(n * BUCKETS, 2**64 - 1, U64)
        np.minimum.at(least, row * BUCKETS + (g >> U64(60)).astype(np.int64), g << U64(4))
        some = least != 2**64 - 1
        value = least[some]
        exponent = np.frexp(value.astype(np.float64))[1]  # value < 2**exponent, up to rounding
        over = (exponent > 0) & ((value >> np.minimum(np.maximum(exponent - 1, 0), 63).astype(U64)) == 0)
        exponent -= over
        zeros = np.minimum(64 - exponent, 62)
        shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(U64)
        mantissa = ((value >> shift) & U64((1 << MANTISSA) - 1)).astype(np.int64)
        flat = np.zeros(n * BUCKETS, np.uint16)
        flat[some] = ((zeros + 1) << MANTISSA | mantissa).astype(np.uint16)
        out[:, k] = flat.reshape(n, BUCKETS)
    return out.reshape(n, REGISTERS)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, digest, registers`` of every text; the digest of 16 bytes and the registers of 256 tell a set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ragged.blocks(batches):
            h, row, size = shingle_sets(block, width)
            n = len(size)
            sums = np.zeros((n, 2), U64)
            full = np.flatnonzero(size)
            order = np.argsort(row, kind="stable")
            h, row = h[order], row[order]
            if len(full):
                begin = np.searchsorted(row, full)
                for k in (0, 1):
                    sums[full, k] = np.add.reduceat(ragged.mix(h * U64(2 * k + 1) + U64(k)), begin)
            reg = registers(h, row, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids), pa.array(size.astype(np.int64)), pa.array([x.tobytes() for x in sums], pa.binary()), pa.array([x.tobytes() for x in reg], pa.binary())],
                ["doc_id", "n", "digest", "registers"],
            )

    return shared.stored(ragged.documents(docs).mapInArrow(run, "doc_id long, n long, digest binary, registers binary"), "signatures", {})


def register_matrix(col: pa.Array) -> np.ndarray:
    return ragged.string_buffers(col)[0].view(np.uint16).reshape(-1, REGISTERS)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SOME rows at most: a class has up to 32 bands, each of which may be sent with all registers."""
    for batch in batches:
        for a in range(0, len(batch), SOME):
            yield batch.slice(a, SOME)


def band_keys(reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands that have a register, and the row of each."""
    n = len(reg)
    parts = np.ascontiguousarray(reg).view(U64)  # four registers make 64 bits
    key = ragged.mix(ragged.mix(parts) + np.arange(REGISTERS // BAND, dtype=U64)[None, :])
    some = (parts != 0).ravel()
    return key.ravel()[some], np.repeat(np.arange(n), REGISTERS // BAND)[some]


EDGE = "a long, b long"


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])


def first_stars(classes: DataFrame, n_buckets: int) -> DataFrame:
    """Links to try, ``a, b``: from every class in a band to the smallest in it.  A task links its own members to its smallest
    first, so a frequent band costs a row a task."""
    kinds = "<u8 <i8"

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, rep = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((rep, key))
            key, rep = key[order], rep[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            hub = rep[np.flatnonzero(first)[np.cumsum(first) - 1]]
            pairs = np.unique(np.stack([hub[~first], rep[~first]]), axis=1) if (~first).any() else np.zeros((2, 0), np.int64)
            out = [(b + matching.DIRECT, matching.pack(c)) for b, c in matching.dealt(matching.buckets_of(pairs[1], n_buckets), list(pairs))]
            out += [(b, matching.pack(c)) for b, c in matching.dealt((key[first] % U64(n_buckets)).astype(np.int64), [key[first], rep[first]])]
            yield matching.packed_batch(out)

        for batch in pieces(batches):
            key, row = band_keys(register_matrix(batch.column("registers")))
            held.append((key, batch.column("doc_id").to_numpy()[row]))
            rows += len(key)
            if rows >= STAR_ROWS:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    def meet(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket >= matching.DIRECT:
            a, b = (np.concatenate(c) for c in zip(*(matching.unpack(p, "<i8 <i8") for p in payloads), strict=True))
        else:
            key, rep = (np.concatenate(c) for c in zip(*(matching.unpack(p, kinds) for p in payloads), strict=True))
            order = np.lexsort((rep, key))
            key, rep = key[order], rep[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            a, b = rep[np.flatnonzero(first)[np.cumsum(first) - 1]][~first], rep[~first]
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
            yield edge_batch(a, b)

    packed = classes.select("doc_id", "registers").mapInArrow(emit, matching.PACKED)
    return matching.grouped(packed, meet, EDGE).where("a <> b").distinct()


def brought(docs: DataFrame, edges: DataFrame, width: int, n_docs: int, compare, schema: str) -> DataFrame:
    """Applies ``compare`` to the whole sets of the distinct ``a, b``: hubs ``a`` and, for each, their members ``b``.

    Sets are made from the texts of the classes concerned only.  A member's set is sent once for each of its edges; a hub's
    once for every PART members, so a frequent hub is dealt over many tasks.  ``compare`` gets a hub, its set (sorted), and
    its members with their sets, flat.
    """
    degree = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts"))
    keyed = shared.stored(edges.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "edges", {})
    asked = keyed.select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), "part").union(keyed.select("a", "a", "part").distinct())
    n_doc_buckets = matching.doc_buckets(n_docs)
    n_buckets = max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_docs >> 9)

    def by_doc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, hub, part = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
            yield from matching.doc_rows(doc, [hub, part], n_doc_buckets)

    kinds = "<i8 <i8 <i8"
    wanted = shared.stored(asked.mapInArrow(by_doc, matching.PACKED), "wanted")
    texts = matching.marked(docs, matching.Sieve(wanted, kinds, n_docs), n_doc_buckets)
    member = "<u8 <i8 <i8 <u4"  # task key, hub, class, set size

    def sets(block: ragged.Block, cols: matching.Columns) -> Iterator[pa.RecordBatch]:
        row, index = matching.rows_of(block, cols[0])
        if not len(row):
            return
        h, of, size = shingle_sets(block, width)
        order = np.lexsort((h, of))
        h, begin = h[order], np.cumsum(size) - size
        hub, part = cols[1][index], cols[2][index]
        key = ragged.mix(ragged.mix(hub.view(U64)) + part.astype(U64))
        rows = []
        for b, (key, hub, doc, n, a) in matching.dealt((key % U64(n_buckets)).astype(np.int64), [key, hub, block.ids[row], size[row], begin[row]]):
            head = len(key).to_bytes(8, "little") + matching.pack([key, hub, doc, n.astype(np.uint32)])
            rows.append((b, head + ragged.gather(h, a, n).tobytes()))
        yield matching.packed_batch(rows)

    def each(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        heads, data = [], []
        for p in payloads:
            n = int.from_bytes(p[:8], "little")
            end = 8 + n * 28
            heads.append(matching.unpack(p[8:end], member))
            data.append(np.frombuffer(p, U64, offset=end))
        key, hub, doc, size = (np.concatenate(c) for c in zip(*heads, strict=True))
        h, size = np.concatenate(data), size.astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]])
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            k = order[x:y]
            own, rest = k[hub[k] == doc[k]], k[hub[k] != doc[k]]
            if len(own) and len(rest):
                yield from compare(int(hub[own[0]]), h[begin[own[0]] : begin[own[0]] + size[own[0]]], doc[rest], size[rest], ragged.gather(h, begin[rest], size[rest]))

    moved = matching.with_text(texts, wanted, kinds, sets, matching.PACKED)
    return matching.grouped(moved, each, schema)


def is_member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array ``known``, not empty, has."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def confirm(docs: DataFrame, edges: DataFrame, width: int, percent: int, n_docs: int) -> DataFrame:
    """Those of the distinct ``a, b`` whose whole sets have 100 * intersection >= percent * union."""

    def compare(hub: int, hub_set: np.ndarray, doc: np.ndarray, size: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        inter = np.bincount(np.repeat(np.arange(len(doc)), size), weights=is_member(sets, hub_set), minlength=len(doc)).astype(np.int64)
        ok = 100 * inter >= percent * (size + len(hub_set) - inter)
        if ok.any():
            yield edge_batch(np.full(int(ok.sum()), hub), doc[ok])

    return shared.stored(brought(docs, edges, width, n_docs, compare, EDGE).distinct(), "confirmed", {})


def difference_links(docs: DataFrame, stars: DataFrame, labels: DataFrame, width: int, percent: int, n_docs: int) -> DataFrame:
    """Links among the members of large groups, by their differences from the group's hub instead of their whole sets.

    With a hub's set H, the sets A and B differ by |A - H| + |B - H| less twice what these two differences share, so differences
    decide every link exactly.  Members whose component is not the hub's are compared with all members, and of the links to one
    component the first is enough; those within the hub's component are connected already.  What differences share is counted
    from the members under each element, so a pair costs as many steps as it has elements in common.  A member is sent once
    to each task of its hub: one up to PART_BYTES of differences, beyond that one for each two parts.
    """
    p = percent

    def differ(hub: int, hub_set: np.ndarray, doc: np.ndarray, size: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.cumsum(size) - size
        deltas = [b""]  # the hub's own
        for a, n in zip(at.tolist(), size.tolist(), strict=True):
            own = sets[a : a + n]
            deltas.append(own[~is_member(own, hub_set)].tobytes() + hub_set[~is_member(hub_set, own)].tobytes())
        cols = [pa.array(np.full(len(deltas), hub)), pa.array(np.append(hub, doc)), pa.array(np.append(len(hub_set), size)), pa.array(deltas, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["hub", "doc_id", "n", "delta"])

    rows = shared.stored(brought(docs, stars, width, n_docs, differ, "hub long, doc_id long, n long, delta binary"), "differences", {})
    rows = rows.join(labels, rows.doc_id == labels.node, "left").select("hub", "doc_id", F.coalesce("label", "doc_id").alias("label"), "n", "delta")
    rows = rows.join(labels.select(F.col("node").alias("hub"), F.col("label").alias("home")), "hub", "left").withColumn("outside", F.col("label") != F.coalesce("home", "hub"))
    rows = shared.stored(rows.drop("home"), "differences", {})
    parts = lambda some: F.ceil(F.sum(F.when(some, F.octet_length("delta") + 64)) / PART_BYTES).cast("long")
    sizes = rows.groupBy("hub").agg(parts(F.col("outside")).alias("outer"), parts(F.lit(True)).alias("all")).where("outer > 0")
    cut = rows.join(sizes, "hub")
    part, every = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["doc_id", "label", "n", "delta", "outside"]
    others = cut.select("hub", part("all").alias("other"), every("outer").alias("part"), *columns, F.lit(False).alias("asks"))
    asking = cut.where(F.col("outside") & (F.col("all") > 1)).select("hub", every("all").alias("other"), part("outer").alias("part"), *columns, F.lit(True).alias("asks"))

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, label, n = (table[c].to_numpy().copy() for c in ("doc_id", "label", "n"))
        asks, outside = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "outside"))
        if label.min() == label.max():
            return
        data, offs = ragged.string_buffers(table["delta"])
        begin, size = offs[:-1] // 8, np.diff(offs) // 8
        element = ragged.dedupe(data.view(U64))[1].astype(np.int32)
        owner = np.repeat(np.arange(len(doc), dtype=np.int32), size)
        held = ~asks[owner]
        order = np.argsort(element[held], kind="stable")
        under = owner[held][order]  # the other members under each element, one element after the other
        count = np.bincount(element[held], minlength=int(element.max(initial=-1)) + 1)
        first = np.cumsum(count) - count
        for i in np.flatnonzero(asks if asks.any() else outside).tolist():
            own = element[begin[i] : begin[i] + size[i]]
            both = np.bincount(under[ragged.spread(first[own], count[own])], minlength=len(doc))
            ok = np.flatnonzero(((100 - p) * (n[i] + n) >= (100 + p) * (size[i] + size - 2 * both)) & ~asks & (label != label[i]))
            if len(ok):
                found, at = np.unique(label[ok], return_index=True)
                yield edge_batch(np.full(len(at), doc[i]), doc[ok[at]])
                label[np.isin(label, found)] = label[i]

    dealt = others.union(asking).repartition("hub", "part", "other").sortWithinPartitions("hub", "part", "other")
    return shared.stored(by_group(dealt, ["hub", "part", "other"], each).distinct(), "difference-links", {})


def by_group(rows: DataFrame, keys: list[str], run, schema: str = EDGE) -> DataFrame:
    """Applies ``run`` to the rows of each key, which are together and in order; gives ``a, b`` or the columns of ``schema``."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(k).to_numpy() for k in keys]
            change = np.zeros(len(batch) - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            cut = (np.flatnonzero(change) + 1).tolist()
            for a, z in zip([0, *cut], [*cut, len(batch)], strict=True):
                key = tuple(int(c[a]) for c in cols)
                if held and key != now:
                    yield from run(pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(a, z - a))
        if held:
            yield from run(pa.Table.from_batches(held))

    return rows.mapInArrow(each, schema)


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of register rows, corrected for chance agreement, and how many registers they rest on."""
    used = ((x != 0) | (y != 0)).sum(-1)
    same = ((x == y) & (x != 0)).sum(-1)
    return (same / np.maximum(used, 1) - CHANCE) / (1 - CHANCE), used


def open_groups(classes: DataFrame, labels: DataFrame, n_buckets: int, n_classes: int):
    """The classes with labels, a function from batches of them to rows ``key, doc_id, label, registers`` of the bands whose
    members are in several components, and how many parts large bands have."""
    named = classes.join(labels, classes.doc_id == labels.node, "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"), "registers")
    named = shared.stored(named, "named", {})
    kinds = "<u8 <i8 <i8 <u4"

    def bounds(key: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> matching.Columns:
        order = np.argsort(key, kind="stable")
        key, low, high, n = key[order], low[order], high[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return [key[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.add.reduceat(n.astype(np.int64), first).astype(np.uint32)]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                key, row = band_keys(register_matrix(batch.column("registers")))
                label = batch.column("label").to_numpy()[row]
                cols = bounds(key, label, label, np.ones(len(key), np.uint32))
                yield matching.packed_batch([(b, matching.pack(c)) for b, c in matching.dealt((cols[0] % U64(n_buckets)).astype(np.int64), cols)])

    large = max(PART, n_classes // 1000)

    def meet(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, low, high, n = bounds(*(np.concatenate(c) for c in zip(*(matching.unpack(p, kinds) for p in payloads), strict=True)))
        key, n = key[low != high], n[low != high]
        if len(key):
            yield matching.packed_batch([(0, matching.pack([key.view(np.int64), n.astype(np.uint32)]))])
        if (n > large).any():
            yield matching.packed_batch([(-1, matching.pack([key[n > large].view(np.int64), n[n > large].astype(np.uint32)]))])

    unsettled = shared.stored(matching.grouped(named.select("label", "registers").mapInArrow(emit, matching.PACKED), meet), "unsettled")
    hot: dict[int, int] = {}
    for r in unsettled.where("bucket = -1").collect():  # at most a thousand for each band
        key, n = matching.unpack(r.payload, "<i8 <u4")
        hot |= dict(zip(key.tolist(), (-(-n.astype(np.int64) // PART)).tolist(), strict=True))
    # an eighth of a bit for each class and band would do; false members are sorted out by compare_groups()
    test = matching.Sieve(unsettled, "<i8 <u4", 4 * n_classes).tester()

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            reg = register_matrix(batch.column("registers"))
            key, row = band_keys(reg)
            keep = test(key.view(np.int64))
            key, row = key[keep].view(np.int64), row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), batch.column("doc_id").take(pa.array(row)), batch.column("label").take(pa.array(row)), batch.column("registers").take(pa.array(row))], ["key", "doc_id", "label", "registers"]
            )

    return named, members, hot


def nearest(reg: np.ndarray) -> int:
    """The row that has most of the most common registers."""
    score = np.zeros(len(reg), np.int64)
    for k in range(REGISTERS):
        _, inv, n = np.unique(reg[:, k], return_inverse=True, return_counts=True)
        score += inv == np.argmax(n)
    return int(np.argmax(score))


MEMBER = "key long, doc_id long, label long, registers binary"


def group_links(named: DataFrame, members, hot: dict[int, int], percent: int, mode: str) -> DataFrame:
    """Links to try within bands.  ``tries``: in groups of FEW at most, all pairs across components that the estimate leaves
    possible; in larger ones those with the hub, the member nearest to the most common registers.  ``hubs``: in larger groups,
    the hub with every other.  Of very large bands one part elects the hub, which then meets all members where they are."""
    large = np.array(sorted(hot), np.int64)

    def known(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
        return is_member(key, keys) if len(keys) else np.zeros(len(key), bool)

    def electors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in members(batches):
            key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            part = np.array([hot.get(k, 0) for k in key.tolist()], np.int64)
            yield batch.filter(pa.array((part > 0) & (ragged.mix(doc.view(U64)) % np.maximum(part, 1).astype(U64) == 0)))

    def elect(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.slice(nearest(register_matrix(table["registers"])), 1).combine_chunks().to_batches()

    elected = []
    if len(large):
        elected = by_group(named.mapInArrow(electors, MEMBER).repartition("key").sortWithinPartitions("key", "doc_id"), ["key"], elect, MEMBER).collect()
    elected = sorted(elected, key=lambda r: r.key)
    keys, hubs, homes = (np.array([r[k] for r in elected], np.int64) for k in range(3))
    central = np.frombuffer(b"".join(bytes(r.registers) for r in elected), np.uint16).reshape(-1, REGISTERS)

    def possible(sim: np.ndarray, used: np.ndarray) -> np.ndarray:
        t = percent / 100
        return sim >= t - MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1))

    def star(doc: np.ndarray, label: np.ndarray, reg: np.ndarray, hub: np.ndarray, home: np.ndarray, middle: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = possible(*estimate(reg, middle)) & (label != home) if mode == "tries" else doc != hub
        a, b = hub[keep], doc[keep]
        if len(a):
            # a star's hub stays first
            yield edge_batch(a, b) if mode == "hubs" else edge_batch(np.minimum(a, b), np.maximum(a, b))

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in members(batches):
            batch = batch.filter(pa.array(known(keys, batch.column("key").to_numpy())))
            at = np.searchsorted(keys, batch.column("key").to_numpy())
            reg = register_matrix(batch.column("registers"))
            yield from star(batch.column("doc_id").to_numpy(), batch.column("label").to_numpy(), reg, hubs[at], homes[at], central[at])

    def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in members(batches):
            yield batch.filter(pa.array(~known(keys, batch.column("key").to_numpy())))

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, label = table["doc_id"].to_numpy(), table["label"].to_numpy()
        if len(doc) < 2 or label.min() == label.max() or mode == "hubs" and len(doc) <= FEW:
            return
        reg = register_matrix(table["registers"])
        if len(doc) > FEW:
            hub = np.full(len(doc), nearest(reg))
            yield from star(doc, label, reg, doc[hub], label[hub], reg[hub])
            return
        x, y = np.nonzero(possible(*estimate(reg[:, None], reg[None])) & (label[:, None] < label[None]))
        if len(x):
            yield edge_batch(np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]))

    # by doc_id too, so that of members with equal registers the same one is the hub in both modes
    links = by_group(named.mapInArrow(rest, MEMBER).repartition("key").sortWithinPartitions("key", "doc_id"), ["key"], each)
    return (links.union(named.mapInArrow(stars, EDGE)) if elected else links).distinct()


def near_groups(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """Components of documents linked by 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles.

    Words are lower-cased (A-Z).  A text with fewer words is one shingle; one without words, null or empty, is linked with
    nothing.  Texts with equal sets are linked.  Returns a row for each input row: ``doc_id, n_shingles, component_id`` (the
    smallest doc_id that can be reached) ``, kept`` (whether it is that).  With 32 bands, a pair at 85 % shares none with a
    probability below 1e-10.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    sig = signatures(docs, width)
    n_docs = sig.count()
    sets = shared.stored(sig.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes", {})
    classes = sig.where("n > 0").join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "registers").dropDuplicates(["doc_id"])
    classes = shared.stored(classes, "class-registers", {})
    n_classes = classes.count()
    n_buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_classes >> 11)
    links = confirm(docs, first_stars(classes, n_buckets), width, percent, n_docs)
    labels = components.components(links)
    for mode in ("tries", "hubs"):
        more = shared.stored(group_links(*open_groups(classes, labels, n_buckets, n_classes), percent, mode), "tries", {})
        if more.isEmpty():
            continue
        found = difference_links(docs, more, labels, width, percent, n_docs) if mode == "hubs" else confirm(docs, more, width, percent, n_docs)
        links = links.union(found)
        labels = components.components(links)
    named = sets.join(labels, sets.rep == labels.node, "left").select("digest", "copies", F.coalesce("label", "rep").alias("label"))
    hot_sets = shared.hot_keys(sets, "digest", "copies", n_docs)
    full = shared.join_salted(sig.where("n > 0").select("doc_id", "n", "digest"), named.select("digest", "label"), "digest", hot_sets, F.col("doc_id"))
    rows = full.select("doc_id", "n", "label").union(sig.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("label")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), (F.col("doc_id") == F.col("label")).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest doc_id of each near_groups() component."""
    return shared.without(docs, near_groups(docs, width, percent).where(~F.col("kept")))
