"""Vectorised word and shingle hashing for batches of texts inside tasks.

A word is a maximal run of characters other than space and tab to carriage
return; A-Z are lower-cased. Texts are laid end to end in one byte array, white
space shrinks to one separator, and a 64-bit rolling hash over random byte
values gives the hash of any run of words by two prefix lookups.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20_240_101).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, BLOCK_BYTES + 4096), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of some texts: hash prefixes, word bounds, words per text."""

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = _LOWER[np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)]
        space = _SPACE[raw]
        before = np.concatenate(([True], space[:-1]))
        first = np.flatnonzero(~space & before)
        # Keep words and the one white-space byte that ends each of them.
        keep = ~space | ~before
        compact = np.where(space, np.uint8(32), raw)[keep]
        place = np.cumsum(keep) - 1
        self.start = place[first]
        self.end = np.flatnonzero(compact == 32)
        up, self._down = _powers(len(compact) + 1)
        self._prefix = np.concatenate((
            np.zeros(1, dtype=np.uint64), np.cumsum(_VALUE[compact] * up[: len(compact)], dtype=np.uint64)))
        lengths = np.fromiter((len(c) + 1 for c in coded), dtype=np.int64, count=len(coded))
        text_end = np.cumsum(lengths)
        self.bounds = np.concatenate(([0], np.searchsorted(first, text_end)))  # words before each text
        self.compact = compact

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the word runs from word ``first`` to word ``last``, both included."""
        return self.between(self.start[first], self.end[last])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` to before ``end`` of the compact text."""
        return mix((self._prefix[end] - self._prefix[start]) * self._down[start])

    def words(self) -> np.ndarray:
        each = np.arange(len(self.start))
        return self.runs(each, each)

    def shingles(self, size: int) -> list[np.ndarray]:
        """Per text: hashes of its ``size``-word runs in order; with fewer words, of the whole
        sequence as one; with no word, none."""
        counts = np.diff(self.bounds)
        made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        offset = np.concatenate(([0], np.cumsum(made)))
        first = np.arange(offset[-1]) - np.repeat(offset[:-1] - self.bounds[:-1], made)
        last = np.minimum(first + size, np.repeat(self.bounds[1:], made)) - 1
        hashes = self.runs(first, last)
        return [hashes[offset[i]:offset[i + 1]] for i in range(len(counts))]


def blocks(texts: list[str], limit: int = BLOCK_BYTES):
    """(from, to) index ranges of texts that hold about ``limit`` characters each."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Per text: its distinct shingle hashes, sorted."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        out += [np.unique(s) for s in Words(texts[a:b]).shingles(size)]
    return out
