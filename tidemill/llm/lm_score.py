"""Language-model scoring with an Elias-Fano n-gram trie.

A bigram model of the corpus's own training documents in which every word is a context of its own,
as is the start of a text. With counts c, N tokens and V distinct tokens in training::

    P1(w)    = (c(w) - D) / N,        D * V / N for the event of an unknown word
    P(w | v) = c(v, w) / (c(v) + prior) + prior / (c(v) + prior) * P1(w)

which sums to at most 1: probabilities are kept as logarithms rounded down to steps of 1/16.

The model is never in one place and grows with the corpus. Blocks of documents deal their distinct
pairs to ranges of the first word's hash. A range sums the counts, builds its trie
(:mod:`elias_fano`), looks up each block's pairs in it and sends back one code for each pair and
one count for each word. The blocks then add up their documents. Words that make up more than a
quarter of a range's share of all tokens (at most four words a range, so their list is bounded) have
their pairs dealt by both words; their counts go to all blocks. Ranges are as many as the text's
bytes need, and at least the session's partitions.

Words are identified by 64-bit hashes, and under the word before them by 40 bits. Defined results:
a null or wordless text is one end token; texts of any length are read whole; a null doc_id hashes
as the empty text; repeated rows are counted and scored each; without training documents every
token is unknown, base_score is 0 (one unknown type has all the mass) and so is score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .elias_fano import Trie
from .suffixes import _ranges, _sorted_block

END, START = xxhash.xxh64_intdigest(b" ", 0), xxhash.xxh64_intdigest(b"  ", 0)
STEPS = 16  # codes of a factor of ten
NONE = 255  # code of a pair that was not seen
RANGE_BYTES = 32_000_000  # of text to a range, at most


def held_out(doc_id: int, modulus: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id == common.NULL_DOC else str(doc_id).encode()) % modulus == fold


def hash_word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of log10 p, rounded down; 254 is 10^-15.9, far below one of all tokens."""
    return np.clip(np.ceil(-STEPS * np.log10(np.maximum(p, 1e-300))), 0, NONE - 1).astype(np.uint8)


def value(code: np.ndarray) -> np.ndarray:
    return np.where(code == NONE, 0.0, 10.0 ** (-code.astype(np.float64) / STEPS))


class Tokens:
    """The tokens of a block's distinct rows: words by rank of their hash, pairs of a token and the
    one before it by the first word, then the second."""

    def __init__(self, t: pa.Table, frequent: np.ndarray, ranges: int) -> None:
        self.ids, self.th, texts = _sorted_block(t)
        at = {key: i for i, key in enumerate(zip(self.ids.tolist(), self.th.tolist()))}
        #: the distinct row that each row of the table is
        self.rows = np.array([at[key] for key in zip(t["k_doc"].to_pylist(), t["th"].to_pylist())], np.int64)
        numbers, parts = Numbers(), []
        for x in texts:
            parts.append(np.fromiter(map(numbers.__getitem__, x.tobytes().lower().split()), np.int32))
        size = np.array([len(p) + 1 for p in parts], np.int64)
        end = np.cumsum(size) - 1
        hashes = np.array([*map(hash_word, numbers), END, START], np.uint64)
        self.words, rank = np.unique(hashes, return_inverse=True)
        self.end, self.start = int(rank[-2]), int(rank[-1])
        token = np.full(int(size.sum()), len(hashes) - 2, np.int64)
        inside = np.ones(len(token), bool)
        inside[end] = False
        if parts:
            token[inside] = np.concatenate(parts)
        self.token = rank[token]
        self.before = np.empty(len(token), np.int64)
        self.before[1:] = self.token[:-1]
        self.before[end - size + 1] = self.start
        self.doc = np.repeat(np.arange(len(parts)), size)
        self.out = np.array([held_out(int(i)) for i in self.ids], bool)
        w = len(self.words)
        self.pairs, self.pair = np.unique(self.before * w + self.token, return_inverse=True)
        self.count = np.bincount(self.pair, weights=(np.bincount(self.rows, minlength=len(parts)) * ~self.out)[self.doc], minlength=len(self.pairs)).astype(np.int64)
        self.first, self.second = self.pairs // w, self.pairs % w
        own = np.searchsorted(frequent, self.words)
        self.frequent = frequent[np.minimum(own, len(frequent) - 1)] == self.words if len(frequent) else np.zeros(w, bool)
        #: where a frequent word stands in the list of them
        self.place = np.where(self.frequent, own, 0)
        key = self.words[self.first]
        with np.errstate(over="ignore"):
            key = np.where(self.frequent[self.first], (key ^ (self.words[self.second] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15), key)
        to = _ranges(key, ranges)
        #: places of the pairs by range, in order inside each
        self.order = np.argsort(to, kind="stable")
        self.to = to[self.order]

    def by_range(self) -> Iterator[tuple[int, np.ndarray]]:
        """(range, places of its pairs), in order."""
        at = common.run_starts(self.to)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(self.to)]):
            yield int(self.to[a]), self.order[a:b]

    def roots(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first words of a range's pairs, and how many pairs each has."""
        first = self.first[pairs]
        at = common.run_starts(first)
        return first[at], np.diff(np.append(at, len(first)))


_MOVED = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])


class Scorer:
    """The steps as functions of Arrow tables. frequent: hashes (sorted) of the words whose pairs are
    dealt by both words, with their counts; the end and the start of a text are always among them."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, n: int, v: int, ranges: int, prior: float = 3.0, discount: float = 0.75) -> None:
        self.frequent, self.counts, self.n, self.v, self.ranges, self.prior, self.discount = frequent, counts, n, v, ranges, prior, discount

    def single(self, count: np.ndarray) -> np.ndarray:
        """P1 of words with these counts."""
        return np.where(count > 0, (count - self.discount) / max(1, self.n), self.unknown())

    def unknown(self) -> float:
        return min(1.0, self.discount * self.v / self.n) if self.n else 1.0

    def pairs_of_block(self, t: pa.Table) -> pa.Table:
        x, out = Tokens(t, self.frequent, self.ranges), []
        block = t["block"][0].as_py()
        for r, pairs in x.by_range():
            roots, size = x.roots(pairs)
            out.append((r, block, common.pack(np.diff(x.words[roots], prepend=np.uint64(0)), size.astype(np.int32), x.words[x.second[pairs]] >> np.uint64(64 - Trie.BITS), x.count[pairs].astype(np.int32))))
        return common.table(_MOVED, list(zip(*out)) or [[]] * 3)

    def codes_of_range(self, t: pa.Table) -> pa.Table:
        parts = [common.unpack(b) for b in t["blob"].to_pylist()]
        hashes = [np.cumsum(p[0]) for p in parts]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        start = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        key = np.concatenate([(np.repeat(place[a:b], p[1]).astype(np.uint64) << np.uint64(Trie.BITS)) | p[2] for a, b, p in zip(start[:-1], start[1:], parts)])
        sizes = [len(p[3]) for p in parts]
        pairs, of = np.unique(key, return_inverse=True)
        count = np.bincount(of, weights=np.concatenate([p[3] for p in parts]), minlength=len(pairs)).astype(np.int64)
        del key
        root, after = (pairs >> np.uint64(Trie.BITS)).astype(np.int64), pairs & np.uint64((1 << Trie.BITS) - 1)
        total = np.bincount(root, weights=count, minlength=len(words)).astype(np.int64)
        own = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        total = np.where(self.frequent[own] == words, self.counts[own], total)
        known, some = np.flatnonzero(total), count > 0
        rank = np.cumsum(total > 0) - 1
        trie = Trie(words[known], quantised(self.single(total[known])), rank[root[some]], after[some], quantised(count[some] / (total[root[some]] + self.prior)))
        # all that the blocks ask for, each pair and word once
        at = trie.find(words)
        pair = trie.find_pairs(at[root], after)
        code, one = np.full(len(pairs), NONE, np.uint8), np.full(len(words), quantised(np.array([self.unknown()]))[0], np.uint8)
        code[pair >= 0] = trie.pairs[pair[pair >= 0]]
        one[at >= 0] = trie.single[at[at >= 0]]
        of, upto = of.astype(np.int32), np.cumsum([0, *sizes])
        out = [common.pack(code[of[a:b]], one[w], total[w]) for a, b, w in zip(upto, upto[1:], (place[a:b] for a, b in zip(start, start[1:])))]
        return common.table(_MOVED, [t["range"].combine_chunks(), t["block"].combine_chunks(), out])

    def scores_of_block(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return common.table(_SCORED, [[]] * 7)
        x = Tokens(docs, self.frequent, self.ranges)
        said = dict(zip(answers["range"].to_pylist(), answers["blob"].to_pylist()))
        code, one, times = np.empty(len(x.pairs), np.uint8), np.empty(len(x.words), np.uint8), np.zeros(len(x.words), np.int64)
        for r, pairs in x.by_range():
            roots, _ = x.roots(pairs)
            code[pairs], one[roots], times[roots] = common.unpack(said[r])
        # counts of the frequent words, the end among them, are known here
        times[x.frequent] = self.counts[x.place[x.frequent]]
        one[x.frequent] = quantised(self.single(times[x.frequent]))
        if self.n:
            after = times.copy()
            after[x.start] = times[x.end]  # as many starts as ends
            weight = self.prior / (after[x.first] + self.prior)
            p = value(code) + weight * value(one)[x.second]
        else:
            p = np.ones(len(x.pairs))
        base = np.log10((times + 1) / (self.n + self.v + 1))
        m = len(x.ids)
        known = np.bincount(x.doc, weights=times[x.token] > 0, minlength=m).astype(np.int64)
        base = np.bincount(x.doc, weights=base[x.token], minlength=m)
        score = np.bincount(x.doc, weights=np.log10(p)[x.pair], minlength=m)
        tokens = np.bincount(x.doc, minlength=m)
        rows = x.rows
        ids = pa.array(x.ids[rows], mask=x.ids[rows] == common.NULL_DOC)
        return common.table(_SCORED, [ids, x.out[rows], tokens[rows], known[rows], np.full(len(rows), self.n), base[rows], score[rows]])


_COUNTED = pa.schema([("h", pa.int64()), ("n", pa.int64())])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts in; (hash, times) of the words of about a million at a time, ends included."""

    def out(numbers: Numbers, total: np.ndarray, ends: int) -> Iterator[pa.RecordBatch]:
        h = np.array([*map(hash_word, numbers), END], np.uint64)
        yield from common.batches(_COUNTED, [h.view(np.int64), np.append(total[: len(numbers)], ends)])

    numbers, parts, total, ends = Numbers(), [], np.zeros(0, np.int64), 0
    for batch in batches:
        for text in common.texts(batch["text"]):
            parts.append(np.fromiter(map(numbers.__getitem__, text.lower().split()), np.int32))
            ends += 1
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        more = np.bincount(ids, minlength=len(numbers))
        more[: len(total)] += total
        total, parts = more, []
        if len(numbers) > 1_000_000:
            yield from out(numbers, total, ends)
            numbers, total, ends = Numbers(), np.zeros(0, np.int64), 0
    if ends:
        yield from out(numbers, total, ends)


def statistics(docs: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hashes of the frequent words (sorted) with their counts, N and V. The end of a text is one of
    them, and the start, which counts as often, is no token."""
    rows = docs.where(common.fold("doc_id", 7) != 2).select(F.col("text").cast("string").alias("text"))
    words = common.checkpoint(rows.mapInArrow(count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    v, n = words.agg(F.count("*"), F.sum("n")).first()
    n, end = int(n or 0), int(np.uint64(END).astype(np.int64))
    # at most 4 * ranges words have so many of n tokens each
    frequent = words.where((F.col("n") * (4 * ranges) >= n) & (F.col("h") != end)).toPandas()
    ends = words.where(F.col("h") == end).first()
    h = np.array([*frequent["h"], *np.array([END, START], np.uint64).view(np.int64)], np.int64).view(np.uint64)
    c = np.array([*frequent["n"], *[int(ends["n"]) if ends else 0] * 2], np.int64)
    order = np.argsort(h)
    return h[order], c[order], n, int(v)


def score(docs: DataFrame, prior: float = 3.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    ranges = max(common.partitions(docs.sparkSession), -(-common.text_bytes(docs) // RANGE_BYTES))
    scorer = Scorer(*statistics(docs, ranges), ranges, prior)
    block = common.blocks(docs)
    moved = "range int, block int, blob binary"
    pairs = block.groupBy("block").applyInArrow(lambda t: scorer.pairs_of_block(t), moved)
    codes = pairs.groupBy("range").applyInArrow(lambda t: scorer.codes_of_range(t), moved)
    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return block.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(lambda a, b: scorer.scores_of_block(a, b), scored)
