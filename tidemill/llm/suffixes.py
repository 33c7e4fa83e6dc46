"""Suffix-array dedup of repeated passages, with two-stage suffix sorting.

Contract: remove each byte covered by a ``size``-byte string that also starts in a document with a
smaller id. Matches never cross documents and are judged on the input.

Suffix arrays are built only over text that can repeat, next to each other:

1. Every window of ``size`` bytes has a minimizer, the least hash of the k-grams in it. Equal windows
   have equal minimizers, so a minimizer that one document alone has rules its windows out. Blocks
   of documents send sorted, delta-coded minimizers to hash ranges and get back one bit for each:
   whether another document has it too.
2. Runs of windows with one shared minimizer become segments and go, text and all, to that
   minimizer's range. Inside a block equal segments are settled first: all but those of the
   smallest document are removed whole, and only one copy travels, so a passage that a third of all
   documents share arrives once per block.
3. Each range drops equal segments in the same way, and sorts the suffixes of the segments that
   differ in two stages: suffixes smaller than their successor are sorted directly, all others are
   induced from them by scanning buckets from the smallest first byte to the largest. Adjacent
   common prefixes of at least ``size`` bytes join suffixes that start with the same window; those
   above the smallest document of their run are removed.
4. The spans go back to the blocks, which cut the documents.

Defined results: a null text is empty; a null doc_id sorts after all others; rows that share a
doc_id count as one document (none is smaller than the other); texts shorter than size keep all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a k-gram. A window of 50 bytes has 35 of them.
GRAM = 16
#: Windows in a chunk of a long document, and the most in a segment.
CHUNK, LONGEST = 1 << 18, 512
#: Bytes that are sorted together at least, if there are as many.
SORTED_BYTES = 1 << 19
#: Bytes of text to a hash range, at most.
RANGE_BYTES = 16_000_000


def window_keys(data: np.ndarray, size: int) -> np.ndarray:
    """The minimizer of each window of that many bytes."""
    n = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)
    word = np.ndarray((n + 8,), "<u8", raw.data, strides=(1,))
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += word[8 : n + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    width, have = size - GRAM + 1, 1
    while have < width:  # minima of doubling widths
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    # minima are small numbers: one-to-one mixing spreads them evenly over the ranges
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(minimizer, first window, end of windows) of the runs of windows with one minimizer."""
    for at in range(0, len(data) - size + 1, CHUNK):
        part = data[at : at + CHUNK + size - 1]
        keys = window_keys(part, size)
        starts = common.run_starts(keys)
        ends = np.append(starts[1:], len(keys))
        if (ends - starts).max() > LONGEST:
            cut = [np.arange(a, b, LONGEST) for a, b in zip(starts, ends)]
            starts = np.concatenate(cut)
            ends = np.append(starts[1:], len(keys))
        yield keys[starts], starts + at, ends + at


def _suffix_type_s(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the end counts as smaller than all."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    at = np.flatnonzero(differs)
    nearest = at[np.searchsorted(at, np.arange(n))]
    last = nearest == n - 1
    return np.where(last, False, text[np.minimum(nearest, n - 1)] < text[np.minimum(nearest + 1, n - 1)])


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of text (bytes above 0) in the order of their first depth bytes at least.

    Stage one sorts only the suffixes smaller than their successor. Stage two scans the buckets of
    first bytes upwards; a suffix that is larger than its successor comes, inside its bucket,
    in the order in which the scan meets its successor, and before the smaller ones.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = _suffix_type_s(text)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(small)
    prefix = np.ndarray((n,), f"S{depth}", padded.data, strides=(1,))[direct]
    direct = direct[np.argsort(prefix, kind="stable")]
    first = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(done: np.ndarray) -> None:
        before = done[done > 0] - 1
        before = before[~small[before]]
        letter = text[before]
        order = np.argsort(letter, kind="stable")
        before, letter = before[order], letter[order]
        cut = np.flatnonzero(np.append(True, letter[1:] != letter[:-1])) if len(letter) else []
        for a, b in zip(cut, [*cut[1:], len(letter)]):
            waiting[letter[a]].append(before[a:b])

    waiting[text[-1]].append(np.array([n - 1]))  # its successor is the empty suffix
    for c in range(256):
        while waiting[c]:  # a run of one letter brings more of its own bucket
            now = np.concatenate(waiting[c])
            waiting[c].clear()
            out.append(now)
            induce(now)
        own = direct[first[c] : first[c + 1]]
        if len(own):
            out.append(own)
            induce(own)
    return np.concatenate(out)


def same_prefix(text: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Whether each suffix in order shares its first size bytes with the one before it."""
    padded = np.concatenate([text, np.zeros(size + 8, np.uint8)])
    word = np.ndarray((len(text) + size,), "<u8", padded.data, strides=(1,))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        live = np.ones(len(a), bool)
        for k in [*range(0, size - 8, 8), size - 8]:
            live &= word[a + k] == word[b + k]
        same[1:] = live
    return same


def _minima(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of each owner 0, 1, ..."""
    out = np.full(int(owner.max()) + 1 if len(owner) else 0, common.NULL_DOC, np.int64)
    np.minimum.at(out, owner, value)
    return out


def _same(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal texts (by 128-bit hashes), and the first text of each number."""
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<u8").reshape(-1, 2)
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    starts = common.run_starts(digest[order, 0], digest[order, 1])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return number, order[starts]


_SPANS = pa.schema([("block", pa.int32()), ("spans", pa.binary())])
_MOVED = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _sorted_block(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """k_doc, th and the texts of a block's distinct rows in their fixed order."""
    ids, th = t["k_doc"].to_numpy(), t["th"].to_numpy()
    data, offsets = common.text_buffers(t["text"])
    order = np.lexsort((th, ids))
    order = order[common.run_starts(ids[order], th[order])]
    return ids[order], th[order], [data[offsets[i] : offsets[i + 1]] for i in order.tolist()]


def _block_segments(texts: list[np.ndarray], size: int):
    keys, doc, first, last = [], [], [], []
    for i, data in enumerate(texts):
        for k, a, b in segments(data, size):
            keys.append(k), doc.append(np.full(len(k), i, np.int32)), first.append(a), last.append(b)
    if not keys:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(map(np.concatenate, (keys, doc, first, last)))


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys to n equal ranges of their upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Plan:
    """The four steps as functions of Arrow tables. ranges: how many hash ranges there are."""

    def __init__(self, size: int, ranges: int) -> None:
        if size < GRAM + 8:
            raise ValueError(f"windows have at least {GRAM + 8} bytes")
        self.size, self.ranges = size, ranges

    def keys_of_block(self, t: pa.Table) -> pa.Table:
        """Step 1, in a block: its distinct minimizers, and which of them two documents here have."""
        ids, _, texts = _sorted_block(t)
        keys, doc, _, _ = _block_segments(texts, self.size)
        distinct, shared = self.shared_here(keys, ids[doc] if len(doc) else doc)
        to, out = _ranges(distinct, self.ranges), []
        at = common.run_starts(to)
        block = t["block"][0].as_py()
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(to)]):
            steps = np.diff(distinct[a:b] >> np.uint64(8), prepend=np.uint64(0))
            out.append((int(to[a]), block, 0, common.pack(steps, np.packbits(shared[a:b]))))
        return common.table(_MOVED, list(zip(*out)) or [[]] * 4)

    @staticmethod
    def shared_here(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, inverse = np.unique(keys, return_inverse=True)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, owner), np.maximum.at(high, inverse, owner)
        return distinct, low < high

    def shared_keys(self, t: pa.Table) -> pa.Table:
        """Step 1, in a range: a bit for each minimizer of each block, whether two documents have it."""
        parts = []
        for blob in t["blob"].to_pylist():
            steps, bits = common.unpack(blob)
            parts.append((np.cumsum(steps), np.unpackbits(np.frombuffer(bits, np.uint8) if isinstance(bits, bytes) else bits, count=len(steps)).astype(bool)))
        keys, flags = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        distinct, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        both = times > 1
        np.logical_or.at(both, inverse, flags)
        said, at, out = both[inverse], 0, []
        for p in parts:
            out.append(np.packbits(said[at : at + len(p[0])]).tobytes())
            at += len(p[0])
        return common.table(_MOVED, [t["range"].combine_chunks(), t["block"].combine_chunks(), [1] * len(out), out])

    def segments_of_block(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Step 2: the segments that another document may have."""
        if not docs.num_rows or not answers.num_rows:
            return common.table(_MOVED, [[]] * 4)
        ids, _, texts = _sorted_block(docs)
        keys, doc, first, last = _block_segments(texts, self.size)
        distinct, inverse = np.unique(keys, return_inverse=True)
        to = _ranges(distinct, self.ranges)
        shared, count = np.zeros(len(distinct), bool), np.bincount(to, minlength=self.ranges)
        start = np.concatenate([[0], np.cumsum(count)])
        for r, bits in zip(answers["range"].to_pylist(), answers["blob"].to_pylist()):
            shared[start[r] : start[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(count[r]))
        pick = np.flatnonzero(shared[inverse])
        pick = pick[np.argsort(keys[pick], kind="stable")]
        block, out = docs["block"][0].as_py(), []
        ends = last + self.size - 1
        same, _ = _same([texts[d][f:e] for d, f, e in zip(doc[pick].tolist(), first[pick].tolist(), ends[pick].tolist())])
        owner = ids[doc[pick]]
        least = owner == _minima(same, owner)[same]
        if not least.all():
            k = pick[~least]
            out.append((-1 - block, block, 2, self.spans(doc[k], first[k], ends[k] - first[k])))
        pick = pick[least]
        to = _ranges(keys[pick], self.ranges)
        at = common.run_starts(to)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(to)]):
            o = pick[a:b]
            body = b"".join(texts[d][f:e].tobytes() for d, f, e in zip(doc[o].tolist(), first[o].tolist(), ends[o].tolist()))
            out.append((int(to[a]), block, 3, common.pack(keys[o], ids[doc[o]], doc[o].astype(np.int32), first[o].astype(np.int64), (ends[o] - first[o]).astype(np.int32), body)))
        return common.table(_MOVED, list(zip(*out)) or [[]] * 4)

    @staticmethod
    def spans(doc, first, size) -> bytes:
        return common.pack(np.asarray(doc, np.int32), np.asarray(first, np.int64), np.asarray(size, np.int32))

    def spans_of_range(self, t: pa.Table) -> pa.Table:
        """Step 3: what goes, by block."""
        kinds, blocks, blobs = (t[c].to_pylist() for c in ("kind", "block", "blob"))
        out = [(b, x) for kind, b, x in zip(kinds, blocks, blobs) if kind == 2]
        parts = [(b, common.unpack(x)) for kind, b, x in zip(kinds, blocks, blobs) if kind == 3]
        if parts:
            key, owner, doc, first, size = (np.concatenate([p[1][i] for p in parts]) for i in range(5))
            block = np.repeat([p[0] for p in parts], [len(p[1][0]) for p in parts])
            body = b"".join(p[1][5] for p in parts)
            del parts
            offset = np.concatenate([[0], np.cumsum(size)])
            view = memoryview(body)
            same, one = _same([view[a:b] for a, b in zip(offset[:-1].tolist(), offset[1:].tolist())])
            least = _minima(same, owner)
            kept = np.flatnonzero(owner == least[same])
            kept = kept[np.argsort(same[kept], kind="stable")]
            lo, hi = np.searchsorted(same[kept], np.arange(len(one))), np.searchsorted(same[kept], np.arange(len(one)), "right")
            rows, starts, sizes = [np.flatnonzero(owner != least[same])], [], []
            starts.append(np.zeros(len(rows[0]), np.int64)), sizes.append(size[rows[0]])
            for k, a, n in self.repeats(lambda k: body[offset[one[k]] : offset[one[k] + 1]], size[one], least, key[one]):
                times = hi[k] - lo[k]  # a document may hold a segment more than once
                at = np.repeat(lo[k] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                rows.append(kept[at]), starts.append(np.repeat(a, times)), sizes.append(np.repeat(n, times))
            row, start, length = map(np.concatenate, (rows, starts, sizes))
            order = np.argsort(block[row], kind="stable")
            row, start, length = row[order], start[order], length[order]
            at = common.run_starts(block[row]).tolist()
            for a, b in zip(at, [*at[1:], len(row)]):
                r = row[a:b]
                out.append((int(block[r[0]]), self.spans(doc[r], first[r] + start[a:b], length[a:b])))
        return common.table(_SPANS, list(zip(*out)) or [[]] * 2)

    def repeats(self, text, size: np.ndarray, owner: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number, start, size) of what goes from distinct segments: windows that also start in a
        segment of a smaller owner. Only segments with one minimizer can share a window, so
        different minimizers are sorted apart, some together until there is enough text."""
        order = np.argsort(key, kind="stable")
        starts = common.run_starts(key[order])
        ends = np.append(starts[1:], len(order))
        held, n = [], 0
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            held.append(order[a:b])
            n += int(size[order[a:b]].sum())
            if n >= SORTED_BYTES:
                yield self._repeats_among(text, owner, np.concatenate(held))
                held, n = [], 0
        if held:
            yield self._repeats_among(text, owner, np.concatenate(held))

    def _repeats_among(self, text, owner: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [text(k) for k in pick.tolist()]
        # bytes move up by one value so that 0 can end each text; 255 never occurs in UTF-8
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        size = np.array([len(x) for x in texts])
        end = np.cumsum(size + 1)
        raised = np.where(joined == 255, 255, joined + 1).astype(np.uint8)
        raised[end - 1] = 0
        order = two_stage(raised, self.size + 6)
        of = np.searchsorted(end, order, "right")
        whole = order + self.size <= end[of] - 1
        order, of = order[whole], of[whole]
        run = np.cumsum(~same_prefix(raised, order, self.size)) - 1
        owns = owner[pick][of]
        out = np.flatnonzero(owns > _minima(run, owns)[run])
        out = out[np.argsort(order[out])]
        at, which = order[out], of[out]
        first = common.run_starts(which, at - np.arange(len(at)))
        last = np.append(first[1:], len(at)) - 1
        k = which[first]
        return pick[k], at[first] - (end[k] - size[k] - 1), at[last] - at[first] + self.size if len(at) else at

    def removed(self, docs: pa.Table, spans: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """k_doc, th, text and the bytes that go, of a block's distinct rows."""
        ids, th, texts = _sorted_block(docs)
        marks = [np.zeros(len(x) + 1, np.int32) for x in texts]
        for blob in spans["spans"].to_pylist():
            for d, a, n in zip(*(x.tolist() for x in common.unpack(blob))):
                marks[d][a] += 1
                marks[d][a + n] -= 1
        for i, data in enumerate(texts):
            yield int(ids[i]), int(th[i]), data, np.cumsum(marks[i][:-1]) > 0


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())])


def dedup(docs: DataFrame, size: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (UTF-8 bytes; null unless asked
    for) for every row of docs."""
    # as many ranges as the text needs, whatever the session's partitions are
    plan = Plan(size, max(2 * common.partitions(docs.sparkSession), -(-common.text_bytes(docs) // RANGE_BYTES)))
    block = common.blocks(docs)
    moved = "range int, block int, kind int, blob binary"
    keys = block.groupBy("block").applyInArrow(lambda t: plan.keys_of_block(t), moved)
    answers = keys.groupBy("range").applyInArrow(lambda t: plan.shared_keys(t), moved)
    shared = block.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: plan.segments_of_block(a, b), moved)
    spans = shared.groupBy("range").applyInArrow(lambda t: plan.spans_of_range(t), "block int, spans binary")

    def cut(rows: pa.Table, spans: pa.Table) -> pa.Table:
        out = {}
        for k_doc, th, data, gone in plan.removed(rows, spans) if rows.num_rows else ():
            kept = data[~gone].tobytes()
            runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            doc_id = None if k_doc == common.NULL_DOC else k_doc
            out[k_doc, th] = (doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None)
        each = [out[x] for x in zip(rows["k_doc"].to_pylist(), rows["th"].to_pylist())]  # repeated rows get a row each
        return common.table(_OUT, list(zip(*each)) or [[]] * 6)

    return block.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
