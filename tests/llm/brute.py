"""Plain versions of the operators, for small inputs."""

import re
import zlib
from collections import Counter, defaultdict
from math import log, log10

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text)


def shared_windows(docs, width=50):
    """doc_id -> (words, kept words)"""
    first, out = {}, {}
    for i in sorted(docs):
        w, gone = words(docs[i]), set()
        for k in range(len(w) - width + 1):
            if first.setdefault(tuple(w[k : k + width]), i) < i:
                gone.update(range(k, k + width))
        out[i] = (w, [x for k, x in enumerate(w) if k not in gone])
    return out


def repeats(docs, width=100):
    """doc_id -> (bytes, removed flags)"""
    seen, out = set(), {}
    for i in sorted(docs):
        t = docs[i].encode()
        gone = [False] * len(t)
        for k in range(len(t) - width + 1):
            h = t[k : k + width]
            if h in seen:
                gone[k : k + width] = [True] * width
            seen.add(h)
        out[i] = (t, gone)
    return out


def shingles(text, width=5):
    w = words(text.translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_components(docs, percent=85):
    sets = {i: shingles(x) for i, x in docs.items()}
    u = Union(docs)
    ids = sorted(i for i in docs if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                u.join(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in docs}


def quality_counts(text):
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = set()
    for k in range(len(w) - 7):
        if seen[tuple(w[k : k + 8])] > 1:
            again.update(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def signed_hash(*parts, seed=42):
    """The engine's 64-bit hash of strings, longs, and (as b"") four-byte numbers one after another."""
    for p in parts:
        seed = xxhash.xxh64(p.encode() if isinstance(p, str) else p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True), seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def likelihood_ratios(docs, labels, buckets, smoothing=0.5):
    """doc_id -> mean log ratio, and the threshold, from labels of one half each."""
    kinds = defaultdict(set)
    for i, q in labels:
        if i is not None and q is not None:
            kinds[i].add(q)
    known = {i: q == {1} for i, q in kinds.items() if len(q) == 1 and i in docs}
    half = {i: signed_hash(i, (1).to_bytes(4, "little")) % 2 for i in known}
    grams = {}
    for i, text in docs.items():
        h = [signed_hash(w) for w in words(text)]
        grams[i] = [x % buckets for x in h] + [signed_hash(a, b) % buckets for a, b in zip(h, h[1:])]
    every = Counter(g for x in grams.values() for g in x)
    good = Counter(g for i, x in grams.items() if known.get(i) and half[i] == 0 for g in x)
    n, m, prior = sum(every.values()), sum(good.values()), smoothing * buckets
    weight = lambda b: log((good[b] + prior * (p := (every[b] + smoothing) / (n + prior))) / (m + prior) / p) if m else 0.0
    scores = {i: sum(map(weight, x)) / len(x) if x else 0.0 for i, x in grams.items()}
    mine = sorted((scores[i], known[i]) for i in known if half[i] == 1)
    yes, no = sum(k for _, k in mine), sum(not k for _, k in mine)
    best, threshold = 1.0, float("-inf")
    for (a, _), (b, _) in zip(mine, mine[1:]):
        value = sum(k for s, k in mine if s >= b) / yes + sum(not k for s, k in mine if s < b) / no if yes and no else 0
        if a < b and value > best + 1e-9:
            best, threshold = value, (a + b) / 2
    return scores, threshold


def unigram(docs):
    """doc_id -> (held out, tokens, known, N, base score)"""
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    tokens = {i: [*words(x.translate(LOW)), None] for i, x in docs.items()}
    c = Counter(t for i, v in tokens.items() if not out[i] for t in v)
    n, v = sum(c.values()), len(c)
    return {i: (out[i], len(t), sum(c[x] > 0 for x in t), n, sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for i, t in tokens.items()}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_removals(docs, percent=90, shortest=20):
    """doc_id -> (lines, removed line numbers), all pairs of lines by edit distance alone."""
    places, count = defaultdict(list), {}
    for i in sorted(docs):
        count[i] = 0
        for k, line in enumerate(docs[i].split("\n")):
            w = words(re.sub("[0-9]+", "0", line.translate(LOW)))
            count[i] += bool(w)
            if w:
                places[" ".join(w)].append((i, k))
    forms = list(places)
    u = Union(range(len(forms)))
    for a, x in enumerate(forms):
        for b, y in enumerate(forms[:a]):
            most = max(len(x), len(y)) * (100 - percent) // 100
            if min(len(x.encode()), len(y.encode())) >= shortest and abs(len(x) - len(y)) <= most and sum((Counter(x) - Counter(y)).values()) <= most and edit(x, y) <= most:
                u.join(a, b)
    groups = defaultdict(list)
    for n, f in enumerate(forms):
        groups[u.find(n)] += places[f]
    gone = defaultdict(set)
    for g in groups.values():
        for i, k in sorted(g)[1:]:
            gone[i].add(k)
    return {i: (count[i], gone[i]) for i in docs}