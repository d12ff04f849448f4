"""Whole batches of texts as arrays of code points: words, lines and their 64-bit hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Code points that are worked on at once; a longer text is one block of its own.
BLOCK_CHARS = 2_000_000
_POWER = np.uint64(0x9E3779B97F4A7C15)


def blocks(texts: Sequence[str | None], max_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) of consecutive blocks; a null text is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if held and size + len(t) > max_chars:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of every element."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MIXED = mix(np.arange(0x3000))


def _mixed(cp: np.ndarray) -> np.ndarray:
    if len(cp) and int(cp.max()) >= len(_MIXED):
        return mix(cp)
    return _MIXED[cp]


class Block:
    """Code points ``cp`` of texts laid end to end; ``start`` and ``size`` of each text."""

    def __init__(self, texts: list[str]):
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)
        self.n = len(texts)

    def space(self) -> np.ndarray:
        return (self.cp == 32) | ((self.cp >= 9) & (self.cp <= 13))

    def begins(self, outside: np.ndarray) -> np.ndarray:
        """Where runs of code points that are not ``outside`` begin; a text's start ends a run."""
        before = np.empty(len(outside), bool)
        before[1:] = outside[:-1]
        before[self.start[self.size > 0]] = True
        return np.flatnonzero(before & ~outside)

    def hashes(self, begins: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the code points of each run; runs hold up to the next one's begin."""
        if not len(begins):
            return np.zeros(0, np.uint64)
        ends = np.concatenate((begins[1:], [len(self.cp)]))
        at = np.arange(int(begins[0]), len(self.cp)) - np.repeat(begins, ends - begins)
        powers = np.full(int((ends - begins).max()), _POWER, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        values = _mixed(self.cp[begins[0] :]) * powers[at]
        values[outside[begins[0] :]] = 0
        return mix(np.add.reduceat(values, begins - begins[0]))


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (doc, key) pairs: whether an equal one comes earlier, and whether there is an equal one at all."""
    full = keys ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(full, kind="stable")
    same = (full[order][1:] == full[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    earlier, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return earlier, any_
