"""A minimal acyclic transducer from frequent words to token ids, kept in one file that is memory-mapped.

Words are added in sorted order; equal suffix states are shared as soon as they
are complete.  Each arc carries the number of words that come before those
reached through it, so the sum along a word is the word's place in sorted order,
which leads to its ids.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark import SparkContext, SparkFiles


def compile_lexicon(words: Sequence[bytes], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The file's content.  ``ids`` are flat, ``counts`` of them for each word; words are distinct and not empty."""
    order = sorted(range(len(words)), key=words.__getitem__)
    final, arcs = [False], [{}]  # state 0 is the root
    register: dict[tuple, int] = {}
    path, last = [0], b""

    def freeze(depth: int) -> None:
        """Shares the states of the last word below ``depth`` with equal ones."""
        while len(path) - 1 > depth:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][last[len(path) - 1]] = register.setdefault(key, state)

    for k in order:
        word = words[k]
        common = len(os.path.commonprefix([word, last]))
        freeze(common)
        for b in word[common:]:
            final.append(False)
            arcs.append({})
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    freeze(0)
    number, stack, reach = {0: 0}, [0], {}
    live = [0]
    while stack:
        for child in arcs[stack.pop()].values():
            if child not in number:
                number[child] = len(number)
                live.append(child)
                stack.append(child)

    def words_from(state: int) -> int:
        todo = [state]
        while todo:
            s = todo[-1]
            if missing := [c for c in arcs[s].values() if c not in reach]:
                todo += missing
            else:
                reach[todo.pop()] = final[s] + sum(reach[c] for c in arcs[s].values())
        return reach[state]

    words_from(0)
    rows = []
    for s in live:
        before = int(final[s])
        for b, child in sorted(arcs[s].items()):
            rows.append((number[s] << 8 | b, number[child], before))
            before += reach[child]
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    ends = np.zeros(len(live), np.int64)
    for s in live:
        ends[number[s]] = final[s]
    first = np.cumsum(counts) - counts
    by_place = counts[order] if len(words) else np.zeros(0, np.int64)
    flat = [ids[first[k] : first[k] + counts[k]] for k in order]
    parts = {"key": table[:, 0], "next": table[:, 1], "before": table[:, 2], "final": ends, "start": np.cumsum(by_place) - by_place, "len": by_place, "ids": np.concatenate([np.zeros(0, np.int64), *flat])}
    head = json.dumps({n: len(v) for n, v in parts.items()}).encode()
    return len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8) + b"".join(v.astype("<i8").tobytes() for v in parts.values())


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        at = 8 + n + (-n % 8)
        for name, count in json.loads(self.map[8 : 8 + n]).items():
            setattr(self, name, np.frombuffer(self.map, "<i8", count, at))
            at += 8 * count

    def place(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The words' places, -1 for words that it lacks; all are followed at once, a byte a step."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.key):
            return out
        at, state, place = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        step = 0
        while len(at):
            done = lens[at] == step
            good = done & (self.final[state] == 1)
            out[at[good]] = place[good]
            at, state, place = at[~done], state[~done], place[~done]
            key = state << 8 | data[starts[at] + step]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[arc] == key
            at, arc = at[ok], arc[ok]
            state, place = self.next[arc], place[ok] + self.before[arc]
            step += 1
        return out


def share(sc: SparkContext, content: bytes) -> str:
    """Hands the file to all executors, also those that come later; its name is for opened()."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(), name)
    with open(path, "wb") as f:
        f.write(content)
    sc.addFile(path)
    return name


_OPEN: dict[str, Lexicon] = {}


def opened(name: str) -> Lexicon:
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Lexicon(SparkFiles.get(name))
    return _OPEN[name]
