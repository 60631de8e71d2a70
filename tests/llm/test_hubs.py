"""op4: the hub of a large group does not depend on the order of rows."""

import numpy as np
import pyarrow as pa
import pytest
from fedrank.llm import minhash

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.mark.parametrize("mode", ["tries", "hubs"])
def test_equal_registers_elect_one_hub(spark, mode):
    def members(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), 7)), *(batch.column(c) for c in ("doc_id", "label", "registers"))], ["key", "doc_id", "label", "registers"])

    same = np.full(minhash.REGISTERS, 5, np.uint16).tobytes()
    ids = list(range(minhash.FEW + 8))
    hubs = []
    for order in (ids, ids[::-1]):
        named = spark.createDataFrame([(i, i, same) for i in order], "doc_id long, label long, registers binary").coalesce(1)
        links = minhash.group_links(named, members, {}, 85, mode).collect()
        assert len(links) == len(ids) - 1
        hubs.append(set.intersection(*({r.a, r.b} for r in links)))
    assert hubs == [{0}, {0}]


@pytest.mark.parametrize("mode", ["tries", "hubs"])
def test_a_very_large_band_has_one_hub(spark, mode):
    """Cut into parts that each have a hub of their own, its links would grow with the square of its members."""

    def members(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), 7)), *(batch.column(c) for c in ("doc_id", "label", "registers"))], ["key", "doc_id", "label", "registers"])

    same = np.full(minhash.REGISTERS, 5, np.uint16).tobytes()
    named = spark.createDataFrame([(i, i, same) for i in range(200)], "doc_id long, label long, registers binary")
    links = minhash.group_links(named, members, {7: 4}, 85, mode).collect()
    assert len(links) == 199 and len(set.intersection(*({r.a, r.b} for r in links))) == 1


@pytest.mark.parametrize("part_bytes", [1 << 24, 2000])
def test_differences_find_all_links(spark, part_bytes, monkeypatch):
    """Variants of one text, some too far from it to be linked: links among these, too, and no pair costs a row for each
    element that its differences have."""
    import random

    import brute

    monkeypatch.setattr(minhash, "PART_BYTES", part_bytes)
    r = random.Random(5)
    base, texts = [f"w{k}" for k in range(300)], {0: " ".join(f"w{k}" for k in range(300))}
    for i in range(1, 90):
        words = texts[i - 1 if i % 3 == 0 else 0].split() if i % 5 else base[:]
        for k in r.sample(range(300), r.choice([2, 5, 9, 12])):
            words[k] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    stars = spark.createDataFrame([(0, i) for i in texts if i], "a long, b long")
    labels = spark.createDataFrame([], "node long, label long")
    sent = []
    by_group = minhash.by_group
    monkeypatch.setattr(minhash, "by_group", lambda rows, *a: sent.append(rows.count()) or by_group(rows, *a))
    found = [(e.a, e.b) for e in minhash.difference_links(docs, stars, labels, 5, 85, len(texts)).collect()]
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in found:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    want = brute.near_components(texts)
    assert {i: root(i) for i in texts} == {i: want[i][1] for i in texts}
    assert len(set(map(root, texts))) > 5 and (part_bytes < 1 << 20 or sent == [len(texts)])
    shared_sets = {i: set(brute.shingles(t)) for i, t in texts.items()}
    assert all(100 * len(shared_sets[a] & shared_sets[b]) >= 85 * len(shared_sets[a] | shared_sets[b]) for a, b in found)


def test_open_bands_are_sent_in_bounded_batches(spark):
    """A batch of classes that are in many open bands would else become one batch with up to 32 times its rows."""
    n = 4 * minhash.SOME + 1
    same = np.full(minhash.REGISTERS, 5, np.uint16).tobytes()
    classes = spark.createDataFrame([(i, same) for i in range(n)], "doc_id long, registers binary")
    _, members, _ = minhash.open_groups(classes, spark.createDataFrame([], "node long, label long"), 4, n)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([same] * n, pa.binary())], ["doc_id", "label", "registers"])
    out = list(members([batch]))
    assert sum(map(len, out)) == 32 * n
    assert max(map(len, out)) <= 32 * minhash.SOME
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == [i for i in range(n) for _ in range(32)]
