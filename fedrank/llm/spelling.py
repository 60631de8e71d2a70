"""The base of the language model: how likely a word is spelled, by a hierarchy of restaurants over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import ragged, seating
from .ragged import U64

END = 32  # ends a word; never a byte of one
STRENGTH = 1.0
#: Contexts are the last byte and 6 bits that hash the two before it: 2**14 restaurants, however much is learnt.
FAR_BITS = 6
CONTEXTS = 256 << FAR_BITS


def with_end(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words flat with END after each."""
    return np.insert(data, np.cumsum(lens), END).astype(np.int64), lens + 1


def cells_of(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The cell (context << 8 | byte) of each byte; words flat, with END after each."""
    place = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
    before = []
    for back in (1, 2, 3):
        b = np.full(len(data), END, np.int64)
        some = np.flatnonzero(place >= back)
        b[some] = data[some - back]
        before.append(b)
    far = ragged.mix((before[1] | before[2] << 8).astype(U64)) >> U64(64 - FAR_BITS)
    return ((before[0] << FAR_BITS | far.astype(np.int64)) << 8) | data


def below(c: np.ndarray, t: np.ndarray, discount: float, parent: np.ndarray) -> np.ndarray:
    """Predictive probabilities of restaurants (rows) given their parents'."""
    return (c - discount * t + (STRENGTH + discount * t.sum(-1, keepdims=True)) * parent) / (STRENGTH + c.sum(-1, keepdims=True))


@dataclass
class Spelling:
    """Natural logarithms of the bytes' probabilities in all contexts."""

    log: np.ndarray

    @classmethod
    def sample(cls, cells: np.ndarray, counts: np.ndarray, seed: int, sweeps: int = 3) -> Spelling:
        """Gibbs sweeps over three levels: contexts, their last bytes, all.  ``counts`` are the customers of ``cells``."""
        d = seating.rate(int((counts == 1).sum()), int((counts == 2).sum()))
        context, byte = cells >> 8, cells & 255
        last = context >> FAR_BITS
        tables = np.minimum(counts, 1)
        parent, root = np.full((256, 256), 1 / 256), np.full(256, 1 / 256)
        t1 = np.ones((256, 256), np.int64)
        for k in range(sweeps):
            keys = [ragged.mix(np.arange(n, dtype=U64) + U64(seed << 32 | k << 28 | level << 26)) for level, n in ((0, len(cells)), (1, 65536), (2, 256))]
            open_ = np.bincount(context, tables, CONTEXTS)
            tables = seating.tables(counts, (STRENGTH + d * open_[context]) * parent[last, byte], d, keys[0])
            c1 = np.bincount(last << 8 | byte, tables, 65536).astype(np.int64).reshape(256, 256)
            t1 = np.minimum(t1, c1)
            t1 = seating.tables(c1.ravel(), ((STRENGTH + d * t1.sum(1, keepdims=True)) * root).ravel(), d, keys[1]).reshape(256, 256)
            c0 = t1.sum(0)
            t0 = seating.tables(c0, (STRENGTH + d * np.minimum(c0, 1).sum()) / 256 * np.ones(256), d, keys[2])
            root = below(c0, t0, d, np.full(256, 1 / 256))
            parent = below(c1, t1, d, root)
        c, t = (np.bincount(cells, x, CONTEXTS << 8).reshape(CONTEXTS, 256) for x in (counts, tables))
        return cls(np.log(below(c, t, d, np.repeat(parent, 1 << FAR_BITS, axis=0))).astype(np.float32))

    def log_words(self, data: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability; words flat, without END."""
        if not len(lens):
            return np.zeros(0)
        data, lens = with_end(data, lens)
        return np.add.reduceat(self.log.ravel()[cells_of(data, lens)].astype(np.float64), np.cumsum(lens) - lens)
