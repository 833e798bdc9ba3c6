"""Vectorised word splitting and 64-bit polynomial hashes for batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
BATCH_TEXTS = 1000

#: BASE * INVERSE = 1 modulo 2^64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2^64."""
    if len(_powers[base]) <= n:
        with np.errstate(over="ignore"):
            _powers[base] = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, 1 << 16), base, np.uint64))))
    return _powers[base]


def scramble(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolled:
    """Hashes of any stretches of a sequence in constant time each; they depend on the stretch's values only."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = powers(INVERSE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n)[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return scramble(raw + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def batches(texts: Iterable[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and (size + len(t) > limit or len(held) == BATCH_TEXTS):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a few texts: where they are, whose they are, and their hashes."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE):
        self.raw = b"\n" + b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(self.raw, np.uint8)
        gap = separators[self.bytes]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offsets = np.concatenate(([1], 1 + np.cumsum(lengths)))
        self.text_start, self.text_end = offsets[:-1], offsets[1:] - 1
        #: of each text, its first word and the word behind its last
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.last = np.append(self.first[1:], len(self.start))
        self.count = self.last - self.first
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.hash = Rolled(self.bytes.astype(np.uint64) + np.uint64(1)).hash(self.start, self.end)
