"""op6: normalised probabilities, scores from one seating, seats against exact distributions and a plain sampler."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from fedrank.llm import hpy, seating, slicing, spelling
from fedrank.llm.ragged import U64
from pyspark.sql import functions as F

pytestmark = pytest.mark.filterwarnings("ignore")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_base_columns(table, plain):
    want = brute.unigram(plain)
    got = by_id(hpy.score(table))
    for i, (out, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    train = [r for i, r in got.items() if not want[i][0]]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def stirling(c, d):
    """Generalised Stirling numbers of ``c`` customers at 0 to ``c`` tables."""
    s = np.zeros((c + 1, c + 2))
    s[0, 0] = 1
    for n in range(c):
        for t in range(n + 2):
            s[n + 1, t] = (s[n, t - 1] if t else 0) + max(n - t * d, 0) * s[n, t]
    return s[c, : c + 1]


@pytest.mark.parametrize("c, alpha, d", [(2, 0.5, 0.7), (3, 4.0, 0.9), (6, 0.5, 0.7), (12, 0.05, 0.9), (20, 2.0, 0.8), (60, 0.3, 0.5), (60, 5.0, 0.85)])
def test_seats_have_the_exact_distribution(c, alpha, d):
    n = 20_000
    t = seating.tables(np.full(n, c), np.full(n, alpha), d, np.arange(n, dtype=U64) * U64(7919))
    p = stirling(c, d) * alpha ** np.arange(c + 1)
    p /= p.sum()
    seen = np.bincount(t, minlength=c + 1) / n
    assert abs(seen - p).sum() / 2 < 0.06


def test_seats_of_all_sizes():
    c = np.array([0, 1, 2, 5, 24, 400, 1_000_000])
    t = np.mean([seating.tables(c, np.full(7, 2.0), 0.5, np.arange(7, dtype=U64) + U64(k << 8)) for k in range(200)], axis=0)
    assert t[0] == 0 and t[1] == 1 and all(np.diff(t[:5]) > 0) and (t <= c).all()
    assert t[-1] == pytest.approx(1 + 2 / 0.5, rel=0.2)  # one, and a Poisson variable of mean alpha / discount


def log_stirling(c, d):
    """Logarithms of generalised Stirling numbers of ``c`` customers at 1 to ``c`` tables."""
    row = np.zeros(1)
    for n in range(1, c):
        row = np.logaddexp(np.append(row + np.log(n - np.arange(1, n + 1) * d), -np.inf), np.insert(row, 0, -np.inf))
    return row


@pytest.mark.parametrize("c, alpha, d", [(200, 2000.0, 0.6), (500, 0.2, 0.9), (700, 1e5, 0.6), (1500, 40.0, 0.7), (1500, 3.0, 0.1), (1500, 4000.0, 0.5)])
def test_all_customers_of_large_dishes_are_seated_anew(c, alpha, d):
    n = 4000
    t = seating.tables(np.full(n, c), np.full(n, alpha), d, np.arange(n, dtype=U64) * U64(7919))
    p = log_stirling(c, d) + np.arange(1, c + 1) * np.log(alpha)
    p = np.exp(p - p.max())
    p /= p.sum()
    mean = p @ np.arange(1, c + 1)
    sd = np.sqrt(p @ (np.arange(1, c + 1) - mean) ** 2)
    assert abs(t.mean() - mean) < 5 * sd / np.sqrt(n) + 1e-9
    assert t.std() == pytest.approx(sd, rel=0.1)


def test_seats_do_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    c, alpha, key = rng.zipf(1.6, 3000).clip(0, 10_000), rng.random(3000) * 3, rng.integers(0, 1 << 62, 3000).astype(U64)
    whole = seating.tables(c, alpha, 0.8, key)
    some = rng.permutation(3000)[:700]
    assert (seating.tables(c[some], alpha[some], 0.8, key[some]) == whole[some]).all()


def test_spelling_sums_to_one():
    flat, lens = spelling.with_end(np.frombuffer(b"abracadabra", np.uint8), np.array([5, 6]))
    cells, n = np.unique(spelling.cells_of(flat, lens), return_counts=True)
    model = spelling.Spelling.sample(cells, n, 1)
    assert np.exp(model.log.astype(float)).sum(1) == pytest.approx(np.ones(spelling.CONTEXTS), abs=1e-5)
    assert model.log_words(np.frombuffer(b"abra", np.uint8), np.array([4]))[0] > model.log_words(np.frombuffer(b"zzzz", np.uint8), np.array([4]))[0]


class Seating:
    """A sample of a fitted model, read from its tables: counts and tables of words (by bucket and place) and of pairs."""

    def __init__(self, model, k):
        state, self.totals = model.states[k]
        self.discount, self.parent_discount = self.totals.discount, self.totals.parent_discount
        self.word, names = {}, defaultdict(dict)
        kept = {r.bucket: slicing.unpress(r.seats) for r in state.collect()}
        for r in model.words.collect():
            (c, log), (open_, customers, tables), (chunk, size, index) = slicing.unpress(r.fixed), kept[r.bucket], slicing.unpress(r.refs)
            for i in range(len(c)):
                self.word[r.bucket, i] = (int(c[i]), int(open_[i]), int(customers[i]), int(tables[i]), math.exp(log[i]))
            cut = np.concatenate([[0], np.cumsum(size)])
            for n, x in enumerate(chunk.tolist()):
                names[x][r.bucket] = [(r.bucket, i) for i in index[cut[n] : cut[n + 1]].tolist()]
        seated = defaultdict(list)
        for r in model.sayings[k].where(F.col("kind") == hpy.TABLES).orderBy("bucket").collect():
            seated[r.chunk].extend(slicing.unpress(r.payload)[0].tolist())
        self.count, self.tables, self.texts = Counter(), {}, {}
        for r in model.chunks.collect():
            ids, count = slicing.unpress(r.docs)
            ids, (code,) = slicing.signed(ids), slicing.unpress(r.codes)
            mine = [w for b in sorted(names[r.chunk]) for w in names[r.chunk][b]]
            tokens = [mine[i] for i in code.tolist()]
            pairs = list(zip([tokens[-1], *tokens[:-1]], tokens, strict=True))
            train = np.repeat(~hpy.held_out(ids), count)
            self.count.update(p for p, t in zip(pairs, train, strict=True) if t)
            words, n_words, _, _ = slicing.unpress(r.slices)
            place = iter(slicing.unpress(r.needed)[0].tolist())
            needed = [names[r.chunk][b][next(place)] for b, n in zip(words.tolist(), n_words.tolist(), strict=True) for _ in range(n)]
            context, word, c, _ = slicing.unpress(r.reported)
            for a, b, n, t in zip(context.tolist(), word.tolist(), c.tolist(), seated[r.chunk], strict=True):
                assert (needed[a], needed[b]) not in self.tables and 1 <= t <= n
                self.tables[needed[a], needed[b]] = t
            ends = np.cumsum(count)
            for i, a, z in zip(ids.tolist(), ends - count, ends, strict=True):
                self.texts[i] = pairs[a:z]

    def parent(self, word):
        _, _, customers, tables, base = self.word[word]
        s, d = self.totals, self.parent_discount
        return (customers - d * tables + (1 + d * s.tables) * base) / (1 + s.customers)

    def probability(self, context, word):
        c = self.count[context, word]
        n, open_ = self.word[context][:2]
        return (c - self.discount * self.tables.get((context, word), min(c, 1)) + (1 + self.discount * open_) * self.parent(word)) / (1 + n)


@pytest.fixture(scope="module")
def model(table, spark):
    old, (hpy.WORD_BYTES, hpy.PAIR_BYTES) = (hpy.WORD_BYTES, hpy.PAIR_BYTES), (20_000, 20_000)
    yield hpy.fit(table.repartition(8, "doc_id"))
    hpy.WORD_BYTES, hpy.PAIR_BYTES = old


def test_probabilities_add_up_to_one(model):
    assert model.chunks.count() > 3
    s = Seating(model, 1)
    assert sum(c for c, *_ in s.word.values()) == model.train_tokens == sum(s.count.values())
    assert (sum(w[2] for w in s.word.values()), sum(w[3] for w in s.word.values())) == (s.totals.customers, s.totals.tables)
    never = 1 - sum(w[4] for w in s.word.values())  # what the base leaves to words that occur nowhere
    d = s.parent_discount
    left = (1 + d * s.totals.tables) * never / (1 + s.totals.customers)
    assert sum(s.parent(w) for w in s.word) + left == pytest.approx(1, abs=1e-6)
    followers = defaultdict(Counter)
    for (a, b), c in s.count.items():
        followers[a][b] = c
    for context, (n, open_, *_) in s.word.items():
        assert sum(followers[context].values()) == n
        assert sum(s.tables.get((context, b), 1) for b in followers[context]) == open_
    for context in [w for w, x in s.word.items() if x[0] > 4][:60]:
        n, open_ = s.word[context][:2]
        total = sum(s.probability(context, w) for w in s.word) + (1 + s.discount * open_) * left / (1 + n)
        assert total == pytest.approx(1, abs=1e-6)


def test_scores_are_of_the_samples(model, table, monkeypatch):
    for name in ("WORD_BYTES", "PAIR_BYTES"):
        monkeypatch.setattr(hpy, name, 20_000)
    samples = [Seating(model, k) for k in (0, 1)]
    for i, r in by_id(hpy.score(table.repartition(8, "doc_id"))).items():
        want = sum(math.log10(sum(s.probability(*p) for s, p in zip(samples, both, strict=True)) / 2) for both in zip(*(s.texts[i] for s in samples), strict=True))
        assert r.score == pytest.approx(want, abs=1e-4 * r.n_tokens)


class Plain:
    """The same model by the book: customers seated one by one, tables sending customers to the parent."""

    def __init__(self, texts, base, d, parent_d, seed=3):
        self.r, self.base, self.d, self.pd = random.Random(seed), base, d, parent_d
        self.sizes, self.customers, self.open = defaultdict(list), Counter(), Counter()
        self.psizes, self.n, self.t = defaultdict(list), 0, 0
        self.tokens = [p for t in texts for p in zip(["", *t[:-1]], t, strict=True)]

    def parent(self, w):
        x = self.psizes[w]
        return (sum(x) - self.pd * len(x) + (1 + self.pd * self.t) * self.base[w]) / (1 + self.n)

    def probability(self, u, w):
        x = self.sizes[u, w]
        return (sum(x) - self.d * len(x) + (1 + self.d * self.open[u]) * self.parent(w)) / (1 + self.customers[u])

    def choose(self, sizes, d, alpha):
        at = self.r.random() * (sum(sizes) - d * len(sizes) + alpha)
        for k, n in enumerate(sizes):
            at -= n - d
            if at < 0:
                sizes[k] += 1
                return False
        sizes.append(1)
        return True

    def seat(self, u, w):
        self.customers[u] += 1
        if self.choose(self.sizes[u, w], self.d, (1 + self.d * self.open[u]) * self.parent(w)):
            self.open[u] += 1
            self.n += 1
            self.t += self.choose(self.psizes[w], self.pd, (1 + self.pd * self.t) * self.base[w])

    def unseat(self, u, w):
        self.customers[u] -= 1
        if self.leave(self.sizes[u, w]):
            self.open[u] -= 1
            self.n -= 1
            self.t -= self.leave(self.psizes[w])

    def leave(self, sizes):
        at = self.r.random() * sum(sizes)
        for k, n in enumerate(sizes):
            at -= n
            if at < 0:
                break
        sizes[k] -= 1
        return not sizes[k] and sizes.pop(k) == 0


def test_against_a_plain_sampler(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 6))) for _ in range(60)]
    follow = {w: r.sample(vocabulary, 6) for w in vocabulary}

    def text():
        out = [r.choice(vocabulary)]
        while r.random() < 0.95:
            out.append(r.choice(follow[out[-1]]) if r.random() < 0.7 else vocabulary[min(59, int(r.expovariate(0.1)))])
        return out

    docs = {i: text() for i in range(150)}
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    got = by_id(hpy.score(frame))
    model = hpy.fit(frame)
    # the plain sampler takes the base from the fitted model, by the words' counts in the texts
    state = Seating(model, 1)
    base = {w: state.word[p[1]][4] for i, t in docs.items() for w, p in zip([*t, ""], state.texts[i], strict=True)}
    train = [[*t, ""] for i, t in docs.items() if zlib.crc32(b"%d" % i) % 5 != 1]
    plain = Plain(train, base, state.discount, state.parent_discount)
    for u, w in plain.tokens:
        plain.seat(u, w)
    total, sweeps = Counter(), 15
    for k in range(sweeps + 10):
        for u, w in plain.tokens:
            plain.unseat(u, w)
            plain.seat(u, w)
        if k >= 10:
            for i, t in docs.items():
                total[i] += sum(math.log10(plain.probability(u, w)) for u, w in zip(["", *t], [*t, ""], strict=True)) / sweeps
    for out in (False, True):
        mine, theirs, n = (sum(f(i) for i in docs if got[i].held_out == out) for f in (lambda i: got[i].score, lambda i: total[i], lambda i: got[i].n_tokens))
        assert mine / n == pytest.approx(theirs / n, abs=0.02)
