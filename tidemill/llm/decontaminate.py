"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case. A document and a benchmark item that share a
seed of ``min_tile`` words are tiled: running Karp-Rabin hashing finds the longest matches of
words that are not marked yet, longest first; each is checked word by word and marked on both
sides, down to matches of min_tile words. Tiles may come in any order, so reordered passages count.
A document is contaminated by an item of whose words its tiles cover ``threshold`` or more.

The benchmark is cut into blocks of about ``block_words`` words by a hash of the item, or one item
where that is longer. One block at a time goes to every executor and meets all documents; with more
than one, each block's rows are written to the shared folder and the block is let go. Documents are
never shuffled.

Defined results: null or wordless texts never match; an item with fewer words than min_tile is
found only as a whole; texts of any length are read whole, in time that grows with their words (and
the logarithm, times the number of different tile lengths); repeated rows are judged each, repeated
items found each; a null doc_id or item_id is carried along; without documents or items no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_WORD = re.compile(r"[^\W_]+")
_BASE = 1_000_003
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Side:
    """Word ids of one text with the windows of unmarked words."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        n = len(ids)
        with np.errstate(over="ignore"):
            x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            powers = lambda base: np.cumprod(np.array([1, *[base] * n], np.uint64), dtype=np.uint64)
            self.down = powers(_INVERSE)
            self.sums = np.zeros(n + 1, np.uint64)
            self.sums[1:] = np.cumsum(x * powers(_BASE)[:n], dtype=np.uint64)
        self.free = ids >= 0

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, Karp-Rabin hashes) of every window of that many unmarked words. The hash is a
        polynomial modulo 2^64, rolled by prefix sums."""
        m = len(self.ids) - size + 1
        if m < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[size:] == marked[:m])
        with np.errstate(over="ignore"):
            return at, (self.sums[at + size] - self.sums[at]) * self.down[at]


def tile(item, doc, min_tile: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the greedy string tiling's tiles: always the longest
    match of unmarked words is marked next, of equally long ones the first in doc, then the first
    in item. Word -1 in doc stands for any word that the item has not.

    The longest length is found by halving, as a match has matches of every smaller length in it."""
    a, b, out = Side(np.asarray(item, np.int64)), Side(np.asarray(doc, np.int64)), []

    def common_windows(size: int) -> np.ndarray:
        return np.intersect1d(a.windows(size)[1], b.windows(size)[1])

    top = min(len(a.ids), len(b.ids))
    while top >= min_tile and len(common_windows(min_tile)):
        size, above = min_tile, top + 1
        while above - size > 1:
            mid = (size + above) // 2
            size, above = (mid, above) if len(common_windows(mid)) else (size, mid)
        both = common_windows(size)
        (at_a, hash_a), (at_b, hash_b) = a.windows(size), b.windows(size)
        starts: dict[int, list[int]] = {}
        keep = np.isin(hash_a, both)
        for i, h in zip(at_a[keep][::-1].tolist(), hash_a[keep][::-1].tolist()):
            starts.setdefault(h, []).append(i)  # the first start is last, to be popped
        keep = np.isin(hash_b, both)
        for d, h in zip(at_b[keep].tolist(), hash_b[keep].tolist()):
            if not b.free[d : d + size].all():
                continue
            left = starts[h]
            while left and not a.free[left[-1] : left[-1] + size].all():
                left.pop()  # what is marked stays marked
            if left and (a.ids[left[-1] : left[-1] + size] == b.ids[d : d + size]).all():
                i = left.pop()
                a.free[i : i + size] = b.free[d : d + size] = False
                out.append((i, d, size))
        top = size - 1
    return out


class Block:
    """Some benchmark items with their seeds."""

    def __init__(self, items: list[tuple], min_tile: int) -> None:
        self.min_tile, self.vocabulary, self.items, seeds = min_tile, {}, [], {}
        for item_id, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            size = min(min_tile, len(ids))
            self.items.append((item_id, ids, size))
            for k in range(len(ids) - size + 1) if ids else ():
                seeds.setdefault(tuple(ids[k : k + size]), set()).add(len(self.items) - 1)
        self.by_size: dict[int, dict[int, list[tuple]]] = {}
        for seed, of in seeds.items():
            self.by_size.setdefault(len(seed), {}).setdefault(self.hash(np.array([seed], np.int64))[0].item(), []).append((seed, of))
        self.sorted = {n: np.sort(np.fromiter(h, np.int64, len(h))) for n, h in self.by_size.items()}

    @staticmethod
    def hash(windows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(windows), np.int64)
        for k in range(windows.shape[1]):
            h = h * np.int64(1_000_003) + windows[:, k] + 1
        return h

    def judge(self, text: str | None) -> Iterator[tuple]:
        """(item_id, item words, covered words, tiles) of every item that shares a seed."""
        get = self.vocabulary.get
        doc = np.array([get(w, -1) for w in words(text)], np.int64)
        near: dict[int, list[int]] = {}
        for n, known in self.sorted.items():
            if len(doc) < n:
                continue
            h = self.hash(np.lib.stride_tricks.sliding_window_view(doc, n))
            at = np.searchsorted(known, h)
            for d in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h).tolist():
                for seed, of in self.by_size[n][int(h[d])]:
                    if tuple(doc[d : d + n].tolist()) == seed:
                        for i in of:
                            near.setdefault(i, []).append(d)
        for i, at in sorted(near.items()):
            item_id, ids, size = self.items[i]
            # tiles lie inside runs of the item's words around its seeds
            own = np.isin(doc, ids)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            parts = sorted({int(np.searchsorted(edge, d, "right")) - 1 for d in at})
            joined: list[int] = []
            for p in parts:
                joined += [*doc[edge[p] : edge[p + 1]].tolist(), -1]
            tiles = tile(np.array(ids), np.array(joined), size)
            yield item_id, len(ids), sum(t[2] for t in tiles), len(tiles)


def contamination(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, threshold: float = 0.8, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles, coverage of every document and item that
    reach the threshold: documents that are not there are clean."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered_words", pa.int32()), ("tiles", pa.int32()), ("coverage", pa.float64())])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def meet(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block([(i, words(t)) for i, t in shared.value], min_tile)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    for item_id, n, covered, tiles in block.judge(text):
                        if covered >= threshold * n:
                            rows.append((doc_id, item_id, n, covered, tiles, covered / n))
                if rows:
                    yield from common.batches(schema, list(zip(*rows)))

        return texts.mapInArrow(run, "doc_id long, item_id long, item_words int, covered_words int, tiles int, coverage double")

    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-int(total) // block_words)
    if n <= 1:
        return meet(sc.broadcast([tuple(r) for r in items.collect()]))  # at most block_words words
    out = []
    for k in range(n):
        shared = sc.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])
        out.append(common.checkpoint(meet(shared)))
        shared.destroy()
    return reduce(DataFrame.unionByName, out)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without contaminated rows; columns stay. Rows are judged by their id and text."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    bad = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("key")).distinct()
    held = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return held.join(bad, "key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
