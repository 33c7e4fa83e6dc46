"""Best-fit-decreasing packing of token sequences.

Documents are tokenised, closed with an end id, and those longer than a sequence are cut; the
pieces are then packed best-fit decreasing: longest first, each into the tightest open sequence.

Piece lengths are small integers, so the whole corpus is a histogram of at most ``capacity``
lengths. The packing runs on that histogram: a segment tree over remaining capacities (how many
open sequences have each) finds the tightest one in logarithmic time, and one step fills as many
equally full sequences with equal pieces as there are pieces for. This is best-fit decreasing of all documents, and
its plan -- which ranks of which length go to which range of sequences -- does not grow with the
corpus. A piece's rank among those of its length is its place in its partition plus the number of
such pieces in earlier partitions, so no partition ever holds all pieces of one length.

Defined results: a null or empty text is a document of just the end id; a null doc_id is a
document like any other; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Texts with other characters go through the tokenizer whole: their classes may differ between
#: releases of Unicode. A special token's string may occur in any text.
_OTHER = re.compile("[^\\t\\n\\r -~\u00a1-\u024f]")

#: The same split for the characters that are left, with their classes written out.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t\\n\\r "
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


#: Characters of texts that are split at once.
_TEXTS = 1_000_000

#: What byte-level models write for each byte.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _VISIBLE)}
#: How a byte-level tokenizer must be set for its words to be those of the split.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Tokens:
    """A text's ids as little-endian 32-bit bytes. Words are looked up once and then kept; a new word
    goes to the tokenizer's model alone, as most of a call is not the word."""

    def __init__(self, path: str, keep: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores; a pool of threads would only wait for work
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

        self.known: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        self.bare = not how.get("normalizer") and _BYTE_LEVEL.items() <= (how.get("pre_tokenizer") or {}).items()
        self.raw = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def plainly(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not self.bare:
            return self.plainly(word)
        return b"".join([self.raw[x.id] for x in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))])

    def learn(self, seen: set[str]) -> None:
        new = seen.difference(self.known)
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = seen
        self.known.update(zip(new, map(self.word, new)))

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of every text in turn."""
        held: list[str | list[str]] = []  # whole texts, and texts as their words
        size = 0

        def told() -> Iterator[bytes]:
            self.learn(set().union(*(x for x in held if isinstance(x, list))))
            for x in held:
                yield self.plainly(x) if isinstance(x, str) else b"".join(map(self.known.__getitem__, x))

        for text in texts:
            whole = _OTHER.search(text) or self.special and self.special.search(text)
            held.append(text if whole else _SPLIT.findall(text))
            size += len(text)
            if size >= _TEXTS:
                yield from told()
                held, size = [], 0
        yield from told()

    def __call__(self, text: str) -> bytes:
        return next(self.each([text]))


class SegmentTree:
    """Counts of open sequences by remaining capacity; finds the least capacity that will do."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int:
        """The least capacity >= least with an open sequence, or -1."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right neighbour has one
                at >>= 1
            if at <= 1:
                return -1
            at += 1
            while at < self.size:  # down, leftmost first
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces): that many pieces of the length,
    from that rank on, go to as many sequences from that one on, at that offset."""
    tree, open_at, used, out = SegmentTree(capacity), {}, 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                start, n, room = used, max(1, left // (capacity // length)), capacity
                used += n
            else:
                start, n = open_at[room].pop()
                tree.add(room, -n)
                if not open_at[room]:
                    del open_at[room]
            # a sequence just made tighter is the tightest: it takes pieces until none fits
            each = room // length
            put, layers = (min(n, left // each), each) if left >= each else (1, left)
            if put < n:
                open_at.setdefault(room, []).append((start + put, n - put))
                tree.add(room, n - put)
            for k in range(layers):
                out.append((length, rank, start, capacity - room + k * length, put))
                rank += put
            left, rest = left - layers * put, room - layers * length
            if rest:
                open_at.setdefault(rest, []).append((start, put))
                tree.add(rest, put)
    return np.array(out, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, place: the cut documents; place counts the
    pieces of the same length that this part has had before."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, place, part = Tokens(tokenizer), [0] * (capacity + 1), TaskContext.get().partitionId()
        close = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text_ids in zip(batch["doc_id"].to_pylist(), tokens.each(text or "" for text in batch["text"].to_pylist())):
                ids = memoryview(text_ids + close)
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append((doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part, place[size]))
                    place[size] += 1
                    at, k = at + size, k + 1
            if rows:
                yield from common.batches(schema, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    cut = common.checkpoint(pieces(docs, tokenizer, capacity, end_id))
    counts = cut.groupBy("length", "part").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # capacity rows at most
    steps = plan(histogram, capacity)
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before.select("length", "part", "before"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.coalesce("before", F.lit(0))).alias("rank"))
    # rows of steps by (length, rank): both bounded by capacity, not by the corpus
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    first = np.searchsorted(steps[:, 0], np.arange(capacity + 2))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                of = length == n
                at[of] = first[n] + np.searchsorted(steps[first[n] : first[n + 1], 1], rank[of], "right") - 1
            yield from common.batches(schema, [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), steps[at, 2] + rank - steps[at, 1], steps[at, 3]])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
