"""Elias-Fano sequences and the n-gram trie built of them, as flat little arrays in one mapping."""

from __future__ import annotations

import mmap

import numpy as np

from .common import run_starts as common_starts


class EliasFano:
    """A monotone sequence of n values below universe in about 2 + log2(universe / n) bits each."""

    def __init__(self, values: np.ndarray, universe: int) -> None:
        values = np.asarray(values, np.uint64)
        self.n = n = len(values)
        self.low_bits = max(0, (int(universe) // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) if n else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(bits, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
        self.high = bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])[:-1].astype(np.int32)
        at = np.arange(n) * self.low_bits
        low = np.zeros((n * self.low_bits) // 64 + 2, np.uint64)
        if self.low_bits:
            part = values & np.uint64((1 << self.low_bits) - 1)
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            np.bitwise_or.at(low, (at >> 6) + 1, np.where(shift > 0, part >> (np.uint64(64) - np.maximum(shift, 1)), 0))
        self.low = low

    def arrays(self) -> list[str]:
        return ["high", "before", "low"]

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.before, i, "right") - 1
        rank = i - self.before[word]
        x, at = self.high[word], word * 64
        for width in (32, 16, 8, 4, 2, 1):  # the rank-th set bit of a word by halves
            half = x & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(half).astype(np.int64)
            upper = rank >= ones
            rank -= ones * upper
            at += width * upper
            x = np.where(upper, x >> np.uint64(width), half)
        return self._joined(at - i, i)

    def stretch(self, a: int, b: int) -> np.ndarray:
        """The values at positions a to b, read in one sweep over the bits."""
        first, last = np.searchsorted(self.before, (a, b - 1), "right") - 1
        ones = np.flatnonzero(np.unpackbits(self.high[first : last + 1].view(np.uint8), bitorder="little")) + first * 64
        i = np.arange(a, b)
        high = ones[a - self.before[first] :][: b - a] - i
        return self._joined(high, i)

    def _joined(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = i * self.low_bits
            w, shift = bit >> 6, (bit & 63).astype(np.uint64)
            low = self.low[w] >> shift | np.where(shift > 0, self.low[w + 1] << (np.uint64(64) - np.maximum(shift, 1)), 0)
            out |= low & np.uint64((1 << self.low_bits) - 1)
        return out

    def successors(self, x: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """For each x, in ascending order, the first position whose value is at least x, else n: one
        sweep over both, a stretch of the sequence at a time."""
        x = np.asarray(x, np.uint64)
        out, done = np.full(len(x), self.n, np.int64), 0
        for a in range(0, self.n, step):
            values = self.stretch(a, min(a + step, self.n))
            upto = int(np.searchsorted(x, values[-1], "right"))
            out[done:upto] = a + np.searchsorted(values, x[done:upto])
            done = upto
            if done == len(x):
                break
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each x the first position in [lo, hi) whose value is at least x, else hi."""
        x, lo, hi = np.asarray(x, np.uint64), np.array(lo, np.int64), np.array(hi, np.int64)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < x[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo


def in_mapping(sequences: tuple[EliasFano, ...], holder: object, names: tuple[str, ...]) -> mmap.mmap:
    """Move the sequences' arrays, and those that holder has under names, into one mapping."""
    arrays = [(s, name, getattr(s, name)) for s in sequences for name in s.arrays()] + [(holder, name, getattr(holder, name)) for name in names]
    size = sum(-(-a.nbytes // 8) * 8 for _, _, a in arrays)
    held, at = mmap.mmap(-1, max(8, size)), 0
    for s, name, a in arrays:
        view = np.frombuffer(held, a.dtype, len(a), at)
        view[:] = a
        setattr(s, name, view)
        at += -(-a.nbytes // 8) * 8
    return held


class Trie:
    """Two levels: words by their hash, and under each the words that were seen after it.

    Level one holds the words' hashes, a quantised unigram log-probability each, and monotone
    pointers to level two. Level two holds the following words, counted relative to the place of the
    word before them so that the whole level is monotone, and a quantised log-probability each.
    Sequences and codes lie in one mapping.
    """

    #: Of a following word's hash.
    BITS = 40

    def __init__(self, words: np.ndarray, single: np.ndarray, root: np.ndarray, after: np.ndarray, pairs: np.ndarray) -> None:
        """words: sorted hashes; root (places of words), after: sorted; single, pairs: their codes."""
        if len(words) >= 1 << (64 - self.BITS):
            raise ValueError("more words than a range of the trie can tell apart: use more ranges")
        self.base = int(words[0]) if len(words) else 0
        top = int(words[-1]) - self.base + 1 if len(words) else 1
        self.words = EliasFano(words - np.uint64(self.base) if len(words) else words, top)
        count = np.bincount(root, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(count)]), len(after) + 1)
        self.after = EliasFano(self.joined(root, after), max(1, len(words)) << self.BITS)
        self.single, self.pairs, self.top = single, pairs, top
        self.mapping = in_mapping((self.words, self.pointers, self.after), self, ("single", "pairs"))

    def joined(self, root: np.ndarray, after: np.ndarray) -> np.ndarray:
        return (root.astype(np.uint64) << np.uint64(self.BITS)) | after.astype(np.uint64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places on level one of hashes in ascending order, -1 where a word is unknown."""
        words = np.asarray(words, np.uint64)
        inside = (words >= np.uint64(self.base)) & (words - np.uint64(self.base) < np.uint64(self.top)) & (self.words.n > 0)
        out = np.full(len(words), -1, np.int64)
        x = words[inside] - np.uint64(self.base)
        at = self.words.successors(x)
        hit = at < self.words.n
        hit[hit] = self.words.get(at[hit]) == x[hit]
        out[inside] = np.where(hit, at, -1)
        return out

    def find_pairs(self, place: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Places on level two of (word's place, word after it) in ascending order, -1 where the
        pair is unknown. Counted relative to their words' places the pairs ascend over the whole
        level, so the search goes on from where the last one ended; the pointers tell whether what
        it finds is still of the word."""
        known = place >= 0
        out = np.full(len(place), -1, np.int64)
        if not self.after.n or not known.any():
            return out
        p = place[known]
        x = self.joined(p, after[known])
        at = self.after.successors(x)
        starts = common_starts(p)
        end = np.repeat(self.pointers.get(p[starts] + 1).astype(np.int64), np.diff(np.append(starts, len(p))))
        hit = at < end
        hit[hit] = self.after.get(at[hit]) == x[hit]
        out[known] = np.where(hit, at, -1)
        return out
