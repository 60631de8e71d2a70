"""Byte-pair merging on ragged arrays, and a bounded cache of encoded pieces.

``Merger`` holds many pre-tokens in one flat array of symbols and, in each
round, applies every sequence's lowest-rank pair at all its places at once.
That is exact because a pair that contains the product of merge ``r`` always
ranks after ``r`` (checked when the merges are loaded), so no new pair can come
before the remaining places of the pair just applied.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Sequence

import numpy as np
import regex

from . import ragged

NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """Byte-level BPE of a tokenizer file, by rank-synchronous merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n_ids = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * self.n_ids
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        made: dict[str, int] = {}
        for r, (a, b) in enumerate(merges):
            if max(made.get(a, -1), made.get(b, -1)) >= r or a + b in made:
                raise ValueError("merges are not in the order in which they were learned")
            made[a + b] = r
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.product = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._build((left << np.uint64(20)) | right)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _build(self, keys: np.ndarray) -> None:
        """An open hash table from a pair to its rank."""
        self.shift = np.uint64(64 - 18)
        size = 1 << 18
        self.keys = np.full(size, 2**64 - 1, np.uint64)
        self.ranks = np.full(size, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            at, one = np.unique(slot[free], return_index=True)
            put = todo[np.flatnonzero(free)[one]]
            self.keys[at], self.ranks[at] = keys[put], put
            left = ~np.isin(todo, put)
            todo, slot = todo[left], slot[left]
            slot = (slot + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        slot = self._slot(key)
        out, at = np.full(len(a), NONE, np.int32), np.arange(len(a))
        while len(at):
            found = self.keys[slot]
            hit = found == key[at]
            out[at[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            at, slot = at[more], (slot[more] + 1) % len(self.keys)
        return out

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of sequences of byte symbols, flat and in order, and how many each has."""
        n = len(lens)
        owner = np.repeat(np.arange(n), lens)
        counts = np.zeros(n, np.int64)
        kept_sym, kept_owner = [], []
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.concatenate([starts, [len(sym)]]))
            low = np.repeat(lowest, size)
            going = low != NONE
            if not going.all():
                kept_sym.append(sym[~going])
                kept_owner.append(owner[~going])
                sym, owner, rank, low = sym[going], owner[going], rank[going], low[going]
                if not len(sym):
                    break
            hit = rank == low
            both = hit[1:] & hit[:-1]
            if both.any():  # a pair of equal symbols in a longer run: every other place, from the left
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
                hit &= (place - begin) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.product[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            check = np.concatenate([new, new[new > 0] - 1])
            rank[check] = NONE
            check = check[check < len(sym) - 1]
            check = check[owner[check] == owner[check + 1]]
            rank[check] = self.rank(sym[check], sym[check + 1])
        if not kept_sym:
            return np.zeros(0, np.int32), counts
        sym, owner = np.concatenate(kept_sym), np.concatenate(kept_owner)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=n).astype(np.int64)

    def encode(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pieces as cut by ragged.chunks(), and how many each has."""
        pre: list[str] = []
        special: list[tuple[int, int]] = []  # at which pre-token, which id
        runs, order = joined(pieces)
        for text in runs:
            for j, part in enumerate(self.split.split(text)) if self.split else ((0, text),):
                if j % 2:
                    special.append((len(pre), self.special[part]))
                    pre.append(part)
                elif part:
                    pre += self.pattern.findall(part)
        raw = [x.encode() for x in pre]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(lens)
        if special:  # one symbol each, which merges with nothing
            keep = np.ones(len(sym), bool)
            for at, i in special:
                keep[ends[at] - lens[at] + 1 : ends[at]] = False
                sym[ends[at] - lens[at]] = i
            short = lens.copy()
            short[[at for at, _ in special]] = 1
            ids, counts = self.merge(sym[keep], short)
        else:
            ids, counts = self.merge(sym, lens)
        return reordered(ids, np.repeat(ends, counts), pieces, order)


def joined(pieces: Sequence[bytes], each: int = 200) -> tuple[list[str], list[int]]:
    """Texts that hold the pieces, and the pieces' order in them.  Pieces share a text only if a cut between them is sure, as in ragged.chunks()."""
    alone, together = [], []
    for k, p in enumerate(pieces):
        z = p[-1]
        sure = p[0] in b" \t\n\v\f\r" and (0x20 < z < 0x7F or (len(p) > 1 and 0x80 <= z < 0xC0 and 0xC3 <= p[-2] < 0xE0))
        (together if sure else alone).append(k)
    runs = [pieces[k].decode() for k in alone]
    runs += [b"".join([pieces[k] for k in together[a : a + each]]).decode() for a in range(0, len(together), each)]
    return runs, alone + together


def reordered(ids: np.ndarray, end_byte: np.ndarray, pieces: Sequence[bytes], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """ids of pieces in their own order, from those of joined() texts and the byte after each id's piece or part of one."""
    ends = np.cumsum([len(pieces[k]) for k in order])
    at = np.searchsorted(end_byte, ends, "right")
    counts = np.empty(len(pieces), np.int64)
    start = np.empty(len(pieces), np.int64)
    start[order] = np.concatenate([[0], at[:-1]])
    counts[order] = np.diff(np.concatenate([[0], at]))
    return ids[ragged.spread(start, counts)], counts


@functools.lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


class PieceCache:
    """Encoded pieces by their bytes.  It holds the first ``most`` different ones, frequent ones come early; the rest are
    encoded again in each block, so results never depend on it."""

    def __init__(self, encode: Callable[[Sequence[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 150_000):
        self.encode, self.most = encode, most
        self.index: dict[bytes, int] = {}
        self.flat, self.start, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def get(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array of ids, and where in it each piece's ids start and how many they are."""
        have = np.fromiter((self.index.get(p, -1) for p in pieces), np.int64, len(pieces))
        flat, start, length = self.flat, self.start, self.len
        missing = np.flatnonzero(have < 0)
        if len(missing):
            new = [pieces[k] for k in missing.tolist()]
            ids, counts = self.encode(new)
            have[missing] = len(start) + np.arange(len(new))
            start = np.concatenate([start, len(flat) + np.cumsum(counts) - counts])
            flat, length = np.concatenate([flat, ids]), np.concatenate([length, counts])
            if room := max(0, min(len(new), self.most - len(self.start))):
                base, size = len(self.start), int(counts[:room].sum())
                self.flat, self.start, self.len = flat[: len(self.flat) + size].copy(), start[: base + room].copy(), length[: base + room].copy()
                for k, p in enumerate(new[:room]):
                    if len(p) <= 256:
                        self.index[p] = base + k
        return flat, start[have], length[have]


def library_encode(path: str) -> Callable[[Sequence[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Pieces to ids by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    size = np.array([len(b) for b in merger(path).bytes_of])

    def encode(pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        runs, order = joined(pieces)
        got = [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.int32), *got])
        return reordered(ids, np.cumsum(size[ids]), pieces, order)

    return encode


_CACHES: dict[tuple, PieceCache] = {}


def cache(path: str, kind: str) -> PieceCache:
    """This process's cache of a tokenizer's pieces; kind: ``library`` or ``merge``."""
    if (path, kind) not in _CACHES:
        _CACHES[path, kind] = PieceCache(library_encode(path) if kind == "library" else merger(path).encode)
    return _CACHES[path, kind]
