"""A hierarchical Pitman-Yor language model: a restaurant for each preceding word, all with one parent, over a base that spells.

* A token's context is the word before it, or the end of text that precedes every text.  A context's restaurant has the
  training tokens that follow it as customers and the words as dishes; the customers of the parent are the tables of all
  contexts, and the parent's base is the spelling model (spelling.py), so words never seen have a probability too.  The
  spelling model learns from the vocabulary, each word once, before the sweeps.
* A sweep seats the customers of every context given the parent, and then the parent's customers, which are the tables that
  the contexts have now (seating.py).  Totals are exact sums over the corpus, and a state's probabilities are taken from one
  seating throughout, so in every context they add up to one.  The first sweeps are left out; over the others probabilities
  are averaged.
* Discounts come from how many words and pairs occur once and twice; both strengths are 1.

The corpus is stored once as chunks of about 1.5 million tokens with a vocabulary of their own.  A chunk's words and pairs, in
the order of their hashes, are cut into one slice for each bucket; a bucket merges its slices of all chunks and replies in
their order, so numbers return without keys.  The chunk of lowest number that has a pair reports it: there its customers are
seated, and the tables go by way of the pair's bucket to all chunks that hold it.  Numbers of buckets are in proportion to the
corpus.  The driver sees totals and the cells of the spelling model, whose number is bounded by its form.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged, seating, shared, spelling
from .ragged import U64
from .slicing import REPLY, SLICE, arrow_schema, bucket_of, cuts, joined, listed, merged, press, rows, signed, sliced, slices, steps, together, union, unpress, unsigned, unsteps

STRENGTH = 1.0
CHUNK_TOKENS = 1_500_000
#: Bytes of text for each bucket of words, and of pairs.
WORD_BYTES, PAIR_BYTES = 16 << 20, 4 << 20
#: A pair is known by so many bits of its hash.
PAIR_BITS = 48

def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"%d" % i) % 5 == 1 for i in ids.tolist()], bool)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    a, b = (ragged.span(ragged.prefix(data, k), start, end, k) for k in (0, 1))
    return ragged.mix(ragged.mix(a + (end - start).astype(U64)) + b)


#: The end of a text, an empty word.
END = word_hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0]


CHUNK = "chunk long, docs binary, codes binary, hashes binary, words binary"


def chunks(docs: DataFrame) -> DataFrame:
    """Stores the corpus: ``docs`` (identifiers, numbers of tokens), ``codes`` (each token's place in the vocabulary),
    ``hashes`` (the vocabulary, ascending) and ``words`` (training tokens, length and bytes of each)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task, number, n_tokens = TaskContext.get().partitionId(), 0, 0

        def flush() -> pa.RecordBatch:
            ids, count, code, h, size = (np.concatenate(c) for c in list(zip(*held, strict=True))[:5])
            data = np.concatenate([x[5] for x in held])
            hashes, first, where = np.unique(h, return_index=True, return_inverse=True)
            code = where[code]
            train = np.bincount(code[np.repeat(~held_out(ids), count)], minlength=len(hashes))
            words = press(train, size[first], ragged.gather(data, (np.cumsum(size) - size)[first], size[first]))
            doc = press(unsigned(ids), count)
            return rows(CHUNK, [task << 32 | number], [doc], [press(code)], [press(steps(hashes))], [words])

        for block in ragged.blocks(batches):
            data = ragged.LOWER[block.data]
            start, end, first = ragged.words(data, block.offs)
            start, end = np.insert(start, first[1:], 0), np.insert(end, first[1:], 0)
            h = word_hashes(data, start, end)
            rep, inv = ragged.dedupe(h)
            size = (end - start)[rep]
            held.append((block.ids, np.diff(first) + 1, inv + sum(len(x[3]) for x in held), h[rep], size, ragged.gather(data, start[rep], size)))
            n_tokens += len(h)
            if n_tokens >= CHUNK_TOKENS:
                yield flush()
                held, number, n_tokens = [], number + 1, 0
        if held:
            yield flush()

    return shared.stored(ragged.documents(docs).mapInArrow(run, CHUNK), "chunks")


class Chunk:
    """The tokens of a chunk: ``code`` of each, ``before`` of the one before it, and the vocabulary's ``hash``es."""

    def __init__(self, docs: bytes, codes: bytes, hashes: bytes):
        ids, self.count = unpress(docs)
        self.ids = signed(ids)
        (self.code,), self.hash = unpress(codes), unsteps(unpress(hashes)[0])
        self.before = np.concatenate([[np.searchsorted(self.hash, END)], self.code[:-1]])  # every text's last token is its end
        self.train = ~held_out(self.ids)

    def keys(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return ragged.mix(self.hash[self.before[at]] * U64(0x9E3779B97F4A7C15) + self.hash[self.code[at]]) >> U64(64 - PAIR_BITS)


VOCABULARY = "bucket long, refs binary, counts binary, spelled binary"


def vocabulary(parts: DataFrame, n_buckets: int) -> DataFrame:
    """Stores the words by bucket: ``refs`` (chunks; length of each one's slice; the words of the slices), training tokens,
    and spelling."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, hashes, words in listed(batches):
            h, (train, size, data) = unsteps(unpress(hashes)[0]), unpress(words)
            total = np.concatenate([[0], np.cumsum(size)])
            yield sliced(chunk, bucket_of(h, 64, n_buckets), lambda a, z: press(steps(h[a:z]), train[a:z], size[a:z], data[total[a] : total[z]]))  # noqa: B023

    def meet(bucket: int, chunk: list[int], payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpress(p) for p in payloads]
        h = np.concatenate([unsteps(p[0]) for p in parts])
        train, size, data = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        rep, inv = ragged.dedupe(h)
        c = np.bincount(inv, train, len(rep)).astype(np.int64)
        refs = press(np.array(chunk), np.array([len(p[0]) for p in parts]), inv)
        spelled = press(size[rep], ragged.gather(data, (np.cumsum(size) - size)[rep], size[rep]))
        yield rows(VOCABULARY, [bucket], [refs], [press(c)], [spelled])

    return shared.stored(merged(parts.select("chunk", "hashes", "words").mapInArrow(emit, SLICE), meet, VOCABULARY), "vocabulary")


def learn_spelling(words: DataFrame, seed: int) -> tuple[spelling.Spelling, np.ndarray]:
    """The spelling model, and: training tokens, words they have, words that occur once, and twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts, spelled in listed(batches):
            (c,), (size, data) = unpress(counts), unpress(spelled)
            start = np.cumsum(size) - size
            some = c > 0
            cells, n = np.unique(spelling.cells_of(*spelling.with_end(ragged.gather(data, start[some], size[some]), size[some])), return_counts=True)
            totals = [c.sum(), some.sum(), (c == 1).sum(), (c == 2).sum()]
            yield rows("cell long, n long", np.concatenate([cells, -1 - np.arange(4)]), np.concatenate([n, totals]))

    got = words.select("counts", "spelled").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    totals = np.zeros(4, np.int64)
    totals[-1 - cell[cell < 0]] = n[cell < 0]
    return spelling.Spelling.sample(cell[cell >= 0], n[cell >= 0], seed), totals


PAIRS = REPLY + ", once long, twice long"
INDEX = -1


def pair_counts(parts: DataFrame, n_buckets: int) -> DataFrame:
    """Stores, for each chunk and bucket, the training tokens of the chunk's pairs all over the corpus (times two, plus one
    if this chunk reports the pair).

    In one row a bucket, with INDEX for a chunk: how many pairs occur ``once`` and ``twice``, and, for pairs of two tokens or
    more: chunks, how many of them each has, their numbers in the bucket, and whether it reports them.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, *rest in listed(batches):
            x = Chunk(*rest)
            key, where = np.unique(x.keys(), return_inverse=True)
            n = np.bincount(where, np.repeat(x.train, x.count), len(key)).astype(np.int64)
            yield sliced(chunk, bucket_of(key, PAIR_BITS, n_buckets), lambda a, z: press(steps(key[a:z]), n[a:z]))  # noqa: B023

    def meet(bucket: int, chunk: list[int], payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpress(p) for p in payloads]
        key = np.concatenate([unsteps(p[0]) for p in parts])
        n = np.concatenate([p[1] for p in parts])
        order = np.argsort(key, kind="stable")
        group = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        total = np.bincount(group, n[order]).astype(np.int64)
        some = np.flatnonzero(n[order] > 0)
        reports = some[np.diff(group[some], prepend=-1) != 0]
        code, number = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        code[order] = total[group] << 1
        code[order[reports]] |= 1
        number[order] = (np.cumsum(total > 1) - 1)[group]
        many = code > 3
        cut = cuts(np.array([len(p[0]) for p in parts]))
        index = press(np.array(chunk), np.array([many[a:z].sum() for a, z in cut]), number[many], code[many] & 1)
        said = [press(code[a:z]) for a, z in cut]
        none = [0] * len(parts)
        yield rows(PAIRS, [*chunk, INDEX], [bucket] * (len(parts) + 1), [*said, index], [*none, int((total == 1).sum())], [*none, int((total == 2).sum())])

    return shared.stored(merged(parts.select("chunk", "docs", "codes", "hashes").mapInArrow(emit, SLICE), meet, PAIRS), "pairs")


COUNTED = "chunk long, docs binary, codes binary, counts binary, reported binary, needed binary, slices binary"


def counted(parts: DataFrame, replies: DataFrame, n_words: int, n_pairs: int) -> DataFrame:
    """Stores the chunks with what is known of their pairs.

    ``counts``: 0, 1 or 2 (and more) training tokens of each token's pair; of the latter, the pair's number in the chunk;
    and the pairs' training tokens.  ``reported``: context and word (by their number among the words needed for that),
    training tokens and key of the pairs of two tokens or more that the chunk reports.  ``needed``: those words' places in
    their slices.  ``slices``: buckets and lengths of the needed words and of the reported pairs.
    """

    def run(row: dict, found: list[dict]) -> pa.RecordBatch:
        x = Chunk(row["docs"], row["codes"], row["hashes"])
        key, at, where = np.unique(x.keys(), return_index=True, return_inverse=True)
        code = np.concatenate([unpress(r["payload"])[0] for r in sorted(found, key=lambda r: r["bucket"])])
        many = code > 3
        flag = np.minimum(code >> 1, 2)[where]
        counts = press(flag, (np.cumsum(many) - 1)[where[flag == 2]], code[many] >> 1)
        own = np.flatnonzero(many & (code & 1 == 1))
        needed, ends = np.unique(np.concatenate([x.before[at[own]], x.code[at[own]]]), return_inverse=True)
        reported = press(ends[: len(own)], ends[len(own) :], code[own] >> 1, key[own])
        bucket = bucket_of(x.hash, 64, n_words)
        place = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        held = [list(slices(b)) for b in (bucket[needed], bucket_of(key[own], PAIR_BITS, n_pairs))]
        parts = press(*(np.array(c, np.int64) for cut in held for c in ([b for b, _, _ in cut], [z - a for _, a, z in cut])))
        return rows(COUNTED, [row["chunk"]], [row["docs"]], [row["codes"]], [counts], [reported], [press(place[needed])], [parts])

    return shared.stored(together(parts, replies.select("chunk", "bucket", "payload"), "chunk", run, COUNTED), "counted")


@dataclass
class Totals:
    """Discounts of contexts and parent, and of a state the parent's customers and tables."""

    discount: float
    parent_discount: float
    customers: int
    tables: int


def parent_weight(s: Totals, log_base: np.ndarray) -> np.ndarray:
    """The weight of a new table for each word in the parent."""
    return (STRENGTH + s.parent_discount * s.tables) * np.exp(log_base.astype(np.float64))


def context_weight(s: Totals, tables: np.ndarray) -> np.ndarray:
    """The weight of a new table in contexts that have ``tables``, before the parent's probability."""
    return STRENGTH + s.discount * tables


SAID = "kind long, bucket long, chunk long, payload binary"
WORDS, TABLES = 0, 1


def said(chunk: int, parts: bytes, pairs: list[np.ndarray], tables: np.ndarray, first: np.ndarray | None = None) -> pa.RecordBatch:
    """What a chunk says of the pairs it reports.  To buckets of words: by how much customers exceed tables for each needed
    word, as a context and as a dish (and ``first``, their places).  To buckets of pairs: the tables."""
    words, n_words, places, n_places = unpress(parts)
    extra = pairs[2] - tables
    up, down = (np.bincount(pairs[k], extra, int(n_words.sum())).astype(np.int64) for k in (0, 1))
    out = []
    for kind, bucket, size, cols in ((WORDS, words, n_words, [up, down, *([] if first is None else [first])]), (TABLES, places, n_places, [tables])):
        out += [(kind, b, chunk, press(*(c[a:z] for c in cols))) for b, (a, z) in zip(bucket.tolist(), cuts(size), strict=True)]
    return rows(SAID, *([x[k] for x in out] for k in range(4)))


STATE = "bucket long, refs binary, fixed binary, seats binary, customers long, tables long"


def settled(words: DataFrame, sayings: DataFrame, before: Totals, seed: int, first: bool = False) -> tuple[DataFrame, Totals]:
    """Stores a state: given the contexts' tables, those of the parent by Gibbs, and the totals.

    ``seats`` are, for each word, the tables of its context, and customers and tables in the parent.  At the ``first`` state
    ``refs`` shrink to the needed words of each chunk.
    """

    def run(row: dict, found: list[dict]) -> pa.RecordBatch:
        c, log_base = unpress(row["fixed"])
        chunk, size, index = unpress(row["refs"])
        cut = dict(zip(chunk.tolist(), cuts(size), strict=True))
        open_, customers, held = c.copy(), c.copy(), []
        for r in sorted(found, key=lambda r: r["chunk"]):
            up, down, *place = unpress(r["payload"])
            at = index[slice(*cut[r["chunk"]])]
            at = at[place[0]] if first else at
            held.append((r["chunk"], at))
            open_[at] -= up  # a chunk has a word once
            customers[at] -= down
        refs = press(np.array([x for x, _ in held], np.int64), np.array([len(i) for _, i in held], np.int64), np.concatenate([np.zeros(0, np.int64), *(i for _, i in held)])) if first else row["refs"]
        key = ragged.mix(np.arange(len(c), dtype=U64) + U64(row["bucket"] << 32)) + U64(seed)
        tables = seating.tables(customers, parent_weight(before, log_base), before.parent_discount, key)
        return rows(STATE, [row["bucket"]], [refs], [row["fixed"]], [press(open_, customers, tables)], [int(customers.sum())], [int(tables.sum())])

    mine = sayings.where(F.col("kind") == WORDS).select("bucket", "chunk", "payload")
    state = shared.stored(together(words.select("bucket", "refs", "fixed"), mine, "bucket", run, STATE), "state")
    n = state.agg(F.coalesce(F.sum("customers"), F.lit(0)).alias("c"), F.coalesce(F.sum("tables"), F.lit(0)).alias("t")).first()
    return state, Totals(before.discount, before.parent_discount, n.c, n.t)


def parent_log(s: Totals, log_base: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Logarithms of the words' probabilities in the parent."""
    return np.log((customers - s.parent_discount * tables + parent_weight(s, log_base)) / (STRENGTH + s.customers)).astype(np.float32)


def sent(bucket: int, refs: bytes, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """To each chunk, the columns at the words it refers to."""
    chunk, size, index = unpress(refs)
    cut = cuts(size)
    for a in range(0, len(chunk), 256):
        some = [index[x:z] for x, z in cut[a : a + 256]]
        yield rows(REPLY, chunk[a : a + 256], [bucket] * len(some), [press(*(c[i] for c in cols)) for i in some])


def replies(state: DataFrame, s: Totals) -> DataFrame:
    """For each chunk and bucket, of the needed words: logarithms of their probabilities in the parent, and their tables as contexts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, refs, fixed, seats in listed(batches):
            open_, *parent = unpress(seats)
            yield from sent(bucket, refs, [parent_log(s, unpress(fixed)[1], *parent), open_])

    return state.select("bucket", "refs", "fixed", "seats").mapInArrow(run, REPLY)


def sample_replies(words: DataFrame, states: list[tuple[DataFrame, Totals]]) -> DataFrame:
    """For each chunk and bucket, of all words: training tokens and, for each state, what replies() gives."""
    totals = [s for _, s in states]
    schema = "bucket long, payload binary"

    def run(row: dict, found: list[dict]) -> pa.RecordBatch:
        c, log_base = unpress(row["fixed"])
        cols = [c]
        for s, r in zip(totals, sorted(found, key=lambda r: r["state"]), strict=True):
            open_, *parent = unpress(r["seats"])
            cols += [parent_log(s, log_base, *parent), open_]
        return pa.Table.from_batches(list(sent(row["bucket"], row["refs"], cols)), schema=arrow_schema(REPLY)).combine_chunks().to_batches()[0]

    seats_ = union([df.select("bucket", "seats", F.lit(k).alias("state")) for k, (df, _) in enumerate(states)])
    return together(words, seats_, "bucket", run, REPLY)


def table_replies(index: DataFrame, sayings: list[DataFrame]) -> DataFrame:
    """For each chunk and bucket, of its pairs of two training tokens or more: their tables in each sample."""

    samples = len(sayings)

    def run(row: dict, found: list[dict]) -> pa.RecordBatch:
        chunk, size, number, own = unpress(row["payload"])
        cut = dict(zip(chunk.tolist(), cuts(size), strict=True))
        tables = np.zeros((samples, int(number.max(initial=-1)) + 1), np.int64)
        for r in found:
            part = slice(*cut[r["chunk"]])
            tables[r["state"], number[part][own[part] == 1]] = unpress(r["payload"])[0]
        return rows(REPLY, chunk, [row["bucket"]] * len(chunk), [press(*tables[:, number[a:z]]) for a, z in cuts(size)])

    told = union([df.where(F.col("kind") == TABLES).select("bucket", "chunk", "payload", F.lit(k).alias("state")) for k, df in enumerate(sayings)])
    return together(index, told, "bucket", run, REPLY)


def seats(pairs: list[np.ndarray], given: list[np.ndarray], s: Totals, seed: int) -> np.ndarray:
    """Tables of the reported pairs, given the state before."""
    context, word, c, key = pairs
    log_p, open_ = given or (np.zeros(0), np.zeros(0))
    return seating.tables(c, context_weight(s, open_[context]) * np.exp(log_p[word].astype(np.float64)), s.discount, ragged.mix(key.astype(U64)) + U64(seed))


def reseat(s: Totals, seed: int) -> Callable[[dict, list[dict]], pa.RecordBatch]:
    def run(row: dict, found: list[dict]) -> pa.RecordBatch:
        pairs = unpress(row["reported"])
        return said(row["chunk"], row["slices"], pairs, seats(pairs, joined(found), s, seed))

    return run


@dataclass
class Model:
    """A fitted model: counted chunks, words with their base, the index of pairs, and of each sample its state, what the
    chunks said of their pairs' tables, and the totals; ``before`` is the state that the first sample was seated given."""

    chunks: DataFrame
    words: DataFrame
    index: DataFrame
    before: tuple[DataFrame, Totals]
    states: list[tuple[DataFrame, Totals]]
    sayings: list[DataFrame]
    train_tokens: int
    train_words: int


def fit(docs: DataFrame, burn_in: int = 1, samples: int = 2, seed: int = 17) -> Model:
    """Learns from documents whose crc32(doc_id as text) mod 5 is not 1.  Tables that nothing reads any more are deleted."""
    shared.small_batches(docs.sparkSession)
    n_bytes = ragged.documents(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n_words, n_pairs = 1 + n_bytes // WORD_BYTES, 1 + n_bytes // PAIR_BYTES
    parts = chunks(docs)
    spelled = vocabulary(parts, n_words)
    model, (n_train, types, ones, twos) = learn_spelling(spelled, seed)
    words = with_base(spelled, model)
    whole, parts = parts, shared.stored(parts.drop("words"), "chunks")
    shared.drop(spelled, whole)
    pairs = pair_counts(parts, n_pairs)
    once = pairs.agg(F.coalesce(F.sum("once"), F.lit(0)).alias("a"), F.coalesce(F.sum("twice"), F.lit(0)).alias("b")).first()
    s = Totals(seating.rate(once.a, once.b), seating.rate(int(ones), int(twos)), 0, int(types))
    index = shared.stored(pairs.where(F.col("chunk") == INDEX).select("bucket", "payload"), "index")
    shared.drop()
    whole = counted(parts, pairs.where(F.col("chunk") != INDEX), n_words, n_pairs)
    shared.drop(parts, pairs)

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, reported, needed, parts in listed(batches):
            pairs = unpress(reported)
            yield said(chunk, parts, pairs, np.ones(len(pairs[0]), np.int64), unpress(needed)[0])

    own = whole.select("chunk", "reported", "slices")
    # the first state has a table for each pair
    states = [settled(words, whole.select("chunk", "reported", "needed", "slices").mapInArrow(begin, SAID), s, seed, True)]
    sayings: list[DataFrame] = []
    for k in range(1, burn_in + samples + 1):
        state, s = states[-1]
        told = shared.stored(together(own, replies(state, s), "chunk", reseat(s, seed + k), SAID), "said")
        states.append(settled(state, told, s, seed + k))
        if k <= burn_in:
            shared.drop(told, states.pop(0)[0])
        else:
            sayings.append(told)
            shared.drop()
    return Model(whole, words, index, states[0], states[1:], sayings, int(n_train), int(types))


def with_base(words: DataFrame, model: spelling.Spelling) -> DataFrame:
    """Stores the vocabulary with ``fixed``: training tokens, and the log probability of the spelling."""
    shipped = words.sparkSession.sparkContext.broadcast(model)
    schema = "bucket long, refs binary, fixed binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, refs, counts, spelled in listed(batches):
            size, data = unpress(spelled)
            yield rows(schema, [bucket], [refs], [press(unpress(counts)[0], shipped.value.log_words(data, size).astype(np.float32))])

    return shared.stored(words.mapInArrow(run, schema), "words")


def score(docs: DataFrame, burn_in: int = 1, samples: int = 2, seed: int = 17) -> DataFrame:
    """log10 probability of every text under the model (see fit()), averaged over ``samples`` states.

    Tokens are the lower-cased (A-Z) words and one end for each text, so null and empty texts have one token.
    ``base_score`` is the add-0.5 unigram model over the same counts.  Perplexity is 10 ** (-score / n_tokens).
    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  Without training documents all words
    have their spelling's probability under an untrained model.
    """
    model = fit(docs, burn_in, samples, seed)
    n_train, below = model.train_tokens, model.train_tokens + 0.5 * (model.train_words + 1)
    totals = [t for _, t in model.states]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(row: dict, found: list[dict]) -> pa.RecordBatch:
        ids, count = unpress(row["docs"])
        ids, (code,) = signed(ids), unpress(row["codes"])
        flag, number, many = unpress(row["counts"])
        before = np.concatenate([code[-1:], code[:-1]])  # every text's last token is its end
        customers, *given = joined([r for r in found if r["kind"] == WORDS])
        tables = joined([r for r in found if r["kind"] == TABLES])
        c = flag.copy()
        c[flag == 2] = many[number]
        mean = np.zeros(len(c))
        for k, s in enumerate(totals):
            log_p, open_ = given[2 * k : 2 * k + 2]
            t = np.minimum(flag, 1)
            if len(many):
                t[flag == 2] = tables[k][number]
            mean += (c - s.discount * t + context_weight(s, open_[before]) * np.exp(log_p[code].astype(np.float64))) / (STRENGTH + customers[before])
        known = customers[code]
        starts = np.cumsum(count) - count
        sums = [np.add.reduceat(v, starts) for v in (np.log10((known + 0.5) / below), np.log10(mean / len(totals)), (known > 0).astype(np.int64))]
        return rows(schema, ids, held_out(ids), count, sums[2], np.full(len(ids), n_train), sums[0], sums[1])

    heard = union([df.withColumn("kind", F.lit(kind)) for kind, df in ((WORDS, sample_replies(model.words, model.states)), (TABLES, table_replies(model.index, model.sayings)))])
    return together(model.chunks.select("chunk", "docs", "codes", "counts"), heard, "chunk", run, schema)
