import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from fedrank.llm import exact, hpy, lines, matching, minhash, packing, quality, ragged, suffixes, tokens, windows

pytestmark = pytest.mark.filterwarnings("ignore")


def by_id(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


@pytest.fixture(scope="session")
def encoded(plain, vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    return {i: tok.encode(t, add_special_tokens=False).ids for i, t in plain.items()}


def test_token_counts(table, plain, encoded, vocabulary):
    got = by_id(tokens.count_tokens(table, vocabulary, limit=50))
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len(plain[i].encode()), len(x), len(x) > 50) for i, x in encoded.items()}


def test_encode_and_decode(table, plain, encoded, vocabulary):
    both = tokens.encode(table, vocabulary, lexicon_size=64, decoded=True).cache()
    got = by_id(both)
    assert {i: list(r.ids) for i, r in got.items()} == encoded
    assert {i: r.text for i, r in got.items()} == plain
    assert {i: r.text for i, r in by_id(tokens.decode(both.select("doc_id", "ids"), vocabulary)).items()} == plain


def test_lexicon_is_exact_and_minimal(tmp_path):
    from fedrank.llm import lexicon

    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"s"})
    counts = np.arange(1, len(words) + 1)
    content = lexicon.compile_lexicon(words, np.arange(counts.sum()), counts)
    path = str(tmp_path / "lexicon.bin")
    with open(path, "wb") as f:
        f.write(content)
    x = lexicon.Lexicon(path)
    ask = [*words, b"ta", b"tapss", b"x", b""]
    data = np.frombuffer(b"".join(ask), np.uint8)
    size = np.array([len(a) for a in ask])
    place = x.place(data, np.cumsum(size) - size, size)
    assert place.tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert len(x.final) == 8  # tap(s) and top(s) share their ends


def test_packing(table, encoded, vocabulary):
    rows = packing.pack(table, vocabulary, limit=64).collect()
    full = {i: np.array([*x, 0], "<u4") for i, x in encoded.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert bytes(r.ids) == full[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(full[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in [*pieces.values(), *sequences.values()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at and n > 0
            at += n
    assert set(pieces) == set(full) and max(sum(n for _, n in s) for s in sequences.values()) <= 64
    total = sum(map(len, full.values()))
    assert len(sequences) * 64 - total < 64 * 4 * 3  # a sequence with room for each block


def test_cost_balance():
    """Against a plain version on rests below the limit; and the costliest sequence is near the mean, nearer than in order."""
    r = np.random.default_rng(4)
    cost = lambda n: n + n * n / 100
    for _ in range(40):
        lengths = r.integers(1, 100, int(r.integers(1, 60)))
        sequences = [[] for _ in range(-(-int(lengths.sum()) // 100))]
        for n in sorted(lengths.tolist(), reverse=True):
            while n:
                fits = [s for s in sequences if 100 - sum(s) >= n]
                part = n if fits else 100 - min(map(sum, sequences))
                (min(fits, key=lambda s: sum(map(cost, s))) if fits else min(sequences, key=sum)).append(part)
                n -= part
        got = defaultdict(list)
        for _, _, n, q, _ in packing.assign(lengths, 100, 1.0, 0.01):
            got[q].append(n)
        total = lambda s: sum(map(cost, s))
        assert sorted(map(total, got.values())) == pytest.approx(sorted(map(total, sequences)))
    lengths = r.integers(1, 40, 400)
    balanced, plain, room = defaultdict(float), [0.0], 100
    for _, _, n, q, _ in packing.assign(lengths, 100, 1.0, 0.01):
        balanced[q] += cost(n)
    for n in lengths.tolist():
        while n:
            part = min(n, room)
            plain[-1] += cost(part)
            n, room = n - part, room - part
            if not room:
                plain, room = [*plain, 0.0], 100
    spread = lambda x: np.std(list(x)[:-1]) / np.mean(list(x)[:-1])
    assert spread(balanced.values()) < spread(plain)


def test_line_dedup(table, plain):
    want = brute.line_removals({i: t for i, t in plain.items()})
    got = by_id(lines.deduplicate_lines(table))
    for i, (n, gone) in want.items():
        kept = "\n".join(x for k, x in enumerate(plain[i].split("\n")) if k not in gone)
        assert (got[i].n_lines, got[i].n_removed, got[i].text) == (n, len(gone), kept), i
    assert got[69].n_removed == 3


@pytest.mark.parametrize("few", [2, 32])
def test_near_duplicates(table, plain, few, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", few)
    want = brute.near_components(plain)
    got = by_id(minhash.near_groups(table))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][1]) for i, r in got.items())
    assert len({want[i][1] for i in range(55, 63)}) == 1


@pytest.mark.parametrize("most", [0, 10**6])
def test_components(spark, most, monkeypatch):
    import random

    from fedrank.llm import components

    monkeypatch.setattr(components, "TASK_LINKS", most)
    r = random.Random(3)
    links = [(r.randint(-50, 150), r.randint(-50, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5)]
    u = brute.Union({n for x in links for n in x})
    for a, b in links:
        u.join(a, b)
    got = {x.node: x.label for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: u.find(n) for a, b in links if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_few_turns(spark, monkeypatch):
    """A chain of ascending nodes, without the one task that joins few links."""
    from fedrank.llm import components

    monkeypatch.setattr(components, "TASK_LINKS", 0)
    turns = []
    real = components.hooked
    monkeypatch.setattr(components, "hooked", lambda edges, turn: turns.append(turn) or real(edges, turn))
    chain = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(chain)
    assert got.where("label = 0").count() == got.count() == 10_001
    assert len(turns) < 20


@pytest.mark.parametrize("buckets", [64, 1 << 16])
def test_quality(table, plain, labels, buckets):
    got = by_id(quality.score(table, labels, buckets=buckets))
    scores, threshold = brute.likelihood_ratios(plain, [(r.doc_id, r.quality) for r in labels.collect()], buckets)
    for i, text in plain.items():
        r, want = got[i], brute.quality_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.score == pytest.approx(scores[i], abs=1e-5)
        assert r.kept == (not r.base_failed and r.score >= threshold) or abs(scores[i] - threshold) < 1e-5
    kept = quality.keep(table, labels, buckets=buckets)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_quality_without_labels(table, labels):
    assert all(r.score == 0 and r.kept != r.base_failed for r in quality.score(table, labels.where("false")).collect())


def test_threshold():
    assert quality.best_threshold([(0.1, True), (0.2, True)]) == quality.best_threshold([]) == -np.inf
    assert quality.best_threshold([(-3.0, False), (-1.0, False), (0.0, True), (2.0, True)]) == -0.5
    assert quality.best_threshold([(1.0, False), (1.0, True), (3.0, True)]) == 2.0


def test_all_labels_count(spark):
    """Of 60,000 labels none is left out, and the threshold is that of all scores."""
    import random

    ids = spark.range(60_000)
    labels = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("quality"))
    assert sum(quality.labelled(labels, half).count() for half in (0, 1)) == 60_000
    r = random.Random(2)
    for digits in (1, 6):
        scores = [(round(r.gauss(good, 1), digits), bool(good)) for good in [0, 1] * 700]
        assert quality.threshold_of(spark.createDataFrame(scores, "score double, good boolean")) == quality.best_threshold(scores)
    for scores in ([(0.1, True), (0.2, True)], [(0.5, True), (0.5, False)], [(-1.0, True), (1.0, False)], [(-3.0, False), (2.0, True)]):
        assert quality.threshold_of(spark.createDataFrame(scores, "score double, good boolean")) == quality.best_threshold(scores)


def test_quality_on_labels_apart(spark):
    """Junk of other words is told from prose by labels that neither the weights nor the threshold have seen."""
    import random

    r = random.Random(2)
    words = [["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150)] for _ in range(2)]
    docs = {i: " ".join(r.choice(words[i % 4 == 0 and r.random() < 0.7]) for _ in range(80)) for i in range(600)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id long, quality int")
    got = by_id(quality.score(frame, labels))
    right = sum(got[i].kept == (i % 4 > 0) for i in range(300, 600))
    assert right >= 295


@pytest.mark.parametrize("width", [16, 100])
def test_suffix_array(table, plain, width):
    want = brute.repeats(plain, width)
    got = by_id(suffixes.remove_repeats(table, width))
    for i, (raw, gone) in want.items():
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(raw), sum(gone), spans, kept), i


def test_frequent_anchors(table, plain, monkeypatch):
    """Runs of frequent anchors are cut into windows."""
    monkeypatch.setattr(matching, "BUCKET_DOCS", 5)
    real = matching.screen
    monkeypatch.setattr(suffixes.matching, "screen", lambda *a: real(*a))
    want = brute.repeats(plain, 100)
    got = by_id(suffixes.remove_repeats(table, 100))
    assert {i: r.n_removed for i, r in got.items()} == {i: sum(g) for i, (_, g) in want.items()}


def test_two_stage_sort():
    rng = np.random.default_rng(1)
    for k in range(100):
        n = int(rng.integers(1, 90))
        text = rng.integers(0 if k % 2 else 97, (0 if k % 2 else 97) + int(rng.integers(1, 4)), n).astype(np.uint8)
        wanted = np.flatnonzero(rng.random(n) < rng.random())
        order = suffixes.two_stage_sort(text, wanted, 16)
        key = lambda i: (text[i : i + 16].tobytes() + bytes(16))[:16]  # noqa: E731, B023
        assert sorted(order.tolist()) == wanted.tolist() and [key(i) for i in order] == sorted(map(key, wanted))


def test_exact(table, plain):
    groups = defaultdict(list)
    for i, t in plain.items():
        groups[t].append(i)
    for keep, best in (("last", max), ("first", min)):
        got = by_id(exact.exact_groups(table, keep=keep))
        for i, t in plain.items():
            k = best(groups[t])
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (k, len(groups[t]), i == k, hashlib.sha256(t.encode()).hexdigest())


def test_exact_with_colliding_digests(table, plain, monkeypatch):
    """Texts that share a digest are groups of their own."""
    monkeypatch.setattr(exact, "digest", lambda text: F.unhex(F.left(F.sha2(text, 256), F.lit(2))))
    for keep, best in (("last", max), ("first", min)):
        got = by_id(exact.exact_groups(table, keep=keep))
        for i, t in plain.items():
            same = [k for k, x in plain.items() if x == t]
            assert (got[i].keep_id, got[i].group_size) == (best(same), len(same))


@pytest.mark.parametrize("most", [-1, 10**6])
def test_filter_probes(spark, monkeypatch, most):
    """Every entry whose digest occurs again is found, others rarely; small pieces, joined or broadcast."""
    monkeypatch.setattr(exact, "PIECE", 64)
    monkeypatch.setattr(exact, "BROADCAST_PIECES", most)
    runs = spark.range(3000).select(F.unhex(F.sha2(F.greatest("id", F.lit(200)).cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id"))
    bits = 1 << 16
    pieces = exact.filters(runs, bits)
    again = {r.doc_id for r in exact.probe(runs, pieces, bits, pieces.count()).where("again").collect()}
    assert again >= set(range(201)) and len(again) < 201 + 300


def test_exact_with_joins_and_hot_groups(table, plain, monkeypatch):
    """The ways for more hits than are broadcast, and for hot groups."""
    monkeypatch.setattr(exact.shared, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(exact.shared, "hot_keys", lambda counts, key, n, total: counts.where(F.col(n) >= 3).select(key, F.lit(True).alias("hot")))
    got = by_id(exact.exact_groups(table))
    assert {i: r.group_size for i, r in got.items()} == {i: sum(x == t for x in plain.values()) for i, t in plain.items()}


def test_shared_windows(table, plain):
    got = by_id(windows.remove_shared_windows(table))
    for i, (w, kept) in brute.shared_windows(plain).items():
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), len(w) - len(kept), " ".join(kept)), i


OPERATORS = {
    "pack": lambda t, l, v: packing.pack(t, v),
    "lines": lambda t, l, v: lines.deduplicate_lines(t),
    "encode": lambda t, l, v: tokens.encode(t, v),
    "near": lambda t, l, v: minhash.near_groups(t),
    "quality": lambda t, l, v: quality.score(t, l),
    "model": lambda t, l, v: hpy.score(t),
    "suffixes": lambda t, l, v: suffixes.remove_repeats(t),
    "exact": lambda t, l, v: exact.exact_groups(t),
    "windows": lambda t, l, v: windows.remove_shared_windows(t),
    "tokens": lambda t, l, v: tokens.count_tokens(t, v),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty, labels, vocabulary):
    assert OPERATORS[name](empty, labels, vocabulary).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows(name, table, labels, vocabulary):
    """A row that is there twice gives equal rows; operators don't crash, and documents that differ stay apart."""
    some = table.where("doc_id IN (1, 2, 45, 46, 64)")
    rows = OPERATORS[name](some.union(some), labels, vocabulary).collect()
    assert {r.doc_id for r in rows} == {1, 2, 45, 46, 64}
    if name != "pack":
        seen = defaultdict(list)
        for r in rows:
            seen[r.doc_id].append(r)
        assert all(len(x) == 2 and x[0] == x[1] for x in seen.values())


def test_crc_matches(table, vocabulary):
    rows = packing.pack(table, vocabulary).withColumn("crc", F.crc32("ids")).collect()
    assert all(r.crc == zlib.crc32(bytes(r.ids)) for r in rows)
