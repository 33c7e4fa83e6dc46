"""Near duplicates: SimHash near-dedup, carried on to exact similarity of word-shingle sets.

Documents link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. The
first candidates are the links that SimHash with its pivot distance tables finds (:mod:`simhash`);
each is verified on the whole sets. Fingerprints of pairs at 0.8 differ by about ten bits, more than
any affordable number of blocks brings together, so what SimHash misses comes from a filter that is
meant to lose none:

All sets are ordered alike: shingles that many documents have stand last, the others by their
hashes. Of a set of n shingles the first n - ceil(0.8 n) + 1 are its prefix: two sets with similarity
0.8 have a shingle in common that is in both prefixes. How many such shingles they need is known too:
what sets have in common beyond is behind the prefix that ends first. Pairs with fewer go before any
set is looked at. Before that, pairs go unlisted whose 256 parities (of how many shingles of a set fall on
each of 256 places) show too many shingles that only one of them has: each such shingle changes one
parity, so the parities differ in no more places than there are such shingles. What is left is verified on the whole sets. How many documents have a shingle is
counted over all documents in a sketch of fixed size (2^22 counters); a count that is too high only
moves a shingle back, in all sets alike, so the sketch decides on cost and never on results.

Equal sets are one node. Nodes that share a prefix shingle first try a few partners, so that a family
of copies becomes one component without its pairs being listed; after that, only nodes of different
components are paired.

The last step is known to miss a few links (README); the first candidates make up for most.

Defined results: wordless texts have an empty set and are copies of each other; a text shorter than
a shingle is one shingle; texts of any length are read whole; shingles are identified by 64-bit
hashes, sets by 64-bit hashes of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components
from .simhash import SEED, shingle_hashes


def prefix_size(n):
    """Shingles of a set of n that a set of similarity 0.8 cannot miss all."""
    return n - (4 * n + 4) // 5 + 1


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.lower().split(), shingle))


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).astype(np.int64))


def parities(s: np.ndarray) -> bytes:
    """256 bits: whether an odd number of a set's shingles falls on each of 256 places."""
    return np.packbits(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).tobytes()


#: Counters of the sketch, and of one of its slices.
COUNTERS, SLICE = 1 << 22, 1 << 16
#: Texts whose sets a task holds at once.
ROWS = 1000


def counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def levels(docs: DataFrame, shingle: int, least: int = 64) -> np.ndarray:
    """Of each counter how many documents' shingles fall on it, as a power of two: 0 up to ``least``
    or four times the mean."""
    moved = pa.schema([("slice", pa.int32()), ("blob", pa.binary())])

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):  # sets of few texts at a time: they take several times their text
                held = [shingle_set(t, shingle) for t in common.texts(batch["text"].slice(k, ROWS))]
                np.add(total, np.bincount(counter(np.concatenate(held)), minlength=COUNTERS), out=total, casting="unsafe")
                del held
        for k in range(0, COUNTERS, SLICE):
            at = np.flatnonzero(total[k : k + SLICE])
            yield from common.batches(moved, [[k // SLICE], [common.pack(np.diff(at, prepend=0).astype(np.uint16), total[k + at])]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch["slice"].to_pylist(), batch["blob"].to_pylist()):
                steps, n = common.unpack(blob)
                held.setdefault(k, np.zeros(SLICE, np.int64))[np.cumsum(steps, dtype=np.int64)] += n
        for k, n in held.items():
            yield from common.batches(moved, [[k], [common.pack(n)]])

    slices = common.identified(docs).select("text").mapInArrow(count, "slice int, blob binary")
    total = np.zeros(COUNTERS, np.int64)
    # 64 slices of fixed size
    for k, blob in slices.repartition("slice").mapInArrow(add, "slice int, blob binary").collect():
        total[k * SLICE : (k + 1) * SLICE] = common.unpack(blob)[0]
    most = max(least, 4 * total.sum() / COUNTERS)
    return np.where(total > most, np.ceil(np.log2(np.maximum(total, 1) / most)), 0).astype(np.uint8)


def in_order(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set's shingles, those that many documents have last."""
    return s[np.argsort(level[counter(s)], kind="stable")]


def nodes(docs: DataFrame, shingle: int, level: np.ndarray) -> DataFrame:
    """k_doc, th, fp, node, n, prefix (its hashes as bytes), parities for every row of docs."""
    schema = pa.schema([("k_doc", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.binary()), ("parities", pa.binary())])

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows = []
            for t in common.texts(batch["text"]):
                h = shingle_hashes(t.lower().split(), shingle)
                s = np.unique(h)
                rows.append((simhash.of_hashes(h), node_of(s), len(s), in_order(s, level)[: prefix_size(len(s))].tobytes() if len(s) else b"", parities(s)))
            if rows:
                fp, *rest = zip(*rows)
                yield from common.batches(schema, [batch["k_doc"], batch["th"], np.array(fp, np.uint64).view(np.int64), *rest])

    return common.identified(docs).mapInArrow(run, "k_doc long, th long, fp long, node long, n long, prefix binary, parities binary")


#: Bits of the filter of rows to compute sets of, and of one of its rows.
FILTER, ROW = 1 << 24, 1 << 15


def sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, items of the nodes whose rows (k_doc, th) are wanted, and of a few others.

    A filter of fixed size passes the rows, so that texts are not shuffled; what it lets through
    beyond them finds no pair."""
    bit = F.pmod(F.xxhash64("k_doc", "th"), F.lit(FILTER))
    found = wanted.groupBy(F.floor(bit / ROW).alias("row")).agg(F.bitmap_construct_agg(bit % ROW).alias("bits")).collect()
    bits = np.zeros(FILTER // 8, np.uint8)
    for row, part in found:
        bits[row * (ROW // 8) : (row + 1) * (ROW // 8)] = np.frombuffer(part, np.uint8)[: ROW // 8]
    schema = pa.schema([("node", pa.int64()), ("items", pa.list_(pa.int64()))])

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["bit"].to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            for k in range(0, batch.num_rows, ROWS):
                items = [shingle_set(t, shingle) for t in common.texts(batch["text"].slice(k, ROWS))]
                yield from common.batches(schema, [[*map(node_of, items)], [x.view(np.int64) for x in items]])

    out = common.identified(docs).select("text", bit.alias("bit")).mapInArrow(run, "node long, items array<long>")
    return out.groupBy("node").agg(F.first("items").alias("items"))


def shared(marked: DataFrame) -> DataFrame:
    """h, node, n: the prefix shingles that more than one node has, of all nodes that have them."""
    out = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch["prefix"].to_pylist()
            size = [len(p) // 8 for p in prefix]
            h = np.frombuffer(b"".join(prefix), np.int64)
            yield from common.batches(out, [h, np.repeat(batch["node"].to_numpy(), size), np.repeat(batch["n"].to_numpy(), size)])

    each = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).mapInArrow(rows, "h long, node long, n long")
    # most shingles have one node: a count for each shingle is made before the nodes move
    many = each.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    return each.join(many, "h", "left_semi")


_PAIR = pa.schema([(c, pa.int64()) for c in ("a", "b", "na", "nb", "c")])
_PAIRS = "a long, b long, na long, nb long, c long"


def _close(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na)


def _alike(bits: np.ndarray, n: np.ndarray, i, j) -> np.ndarray:
    """Whether the parities of sets i and j leave room for a similarity of 0.8: at most a ninth of the
    sum of their sizes may be shingles that only one has."""
    return 9 * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]


def _summed(parts: list) -> list[np.ndarray]:
    a, b, na, nb = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    at = common.run_starts(a, b)
    return [a[at], b[at], na[at], nb[at], np.diff(np.append(at, len(a)))]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    held = None
    for batch in batches:
        now = [batch[c].to_numpy() for c in ("h", "node", "n", "root")]
        now.append(np.frombuffer(b"".join(batch["parities"].to_pylist()), np.uint64).reshape(-1, 4))
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        starts = common.run_starts(now[0])
        if not len(starts):
            continue
        # the last group may go on in the next batch
        yield [x[: starts[-1]] for x in now]
        held = [x[starts[-1] :] for x in now]
    if held is not None:
        yield held


def candidates(list_pairs):
    """Rows (h, node, n, root, parities) sorted by h in, pairs (a < b) with the number of shingles out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for group in whole_groups(batches):
            for part in list_pairs(*group):
                parts.append(part)
                size += len(part[0])
                if size > 2_000_000:
                    yield from common.batches(_PAIR, _summed(parts))
                    parts, size = [], 0
        if parts:
            yield from common.batches(_PAIR, _summed(parts))

    return run


def _ordered(node, n, i, j):
    swap = node[i] > node[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return node[i], node[j], n[i], n[j]


def few_pairs(tries: int, turn: int):
    """About ``tries`` partners of each node, others at each turn."""

    def run(h, node, n, root, bits):
        if len(h) < 2:
            return
        with np.errstate(over="ignore"):
            mixed = (node.view(np.uint64) ^ h.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.lexsort((mixed, h))
        h, node, n, root, bits, mixed = h[order], node[order], n[order], root[order], bits[order], mixed[order]
        i = np.arange(len(h) - 1)
        asks = (mixed[i] >> np.uint64(16)) % prefix_size(n[i]).astype(np.uint64) < tries
        i = i[(h[i] == h[i + 1]) & asks & (root[i] != root[i + 1]) & _close(n[i], n[i + 1])]
        i = i[_alike(bits, n, i, i + 1)]
        yield _ordered(node, n, i, i + 1)

    return run


def across(h, node, n, root, bits):
    """Every pair of two components in a group, once: nodes of the largest component of a group meet
    only the others, so that a family of copies costs no more than its number of outsiders."""
    order = np.lexsort((root, h))
    h, node, n, root, bits = h[order], node[order], n[order], root[order], bits[order]
    starts = common.run_starts(h)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
        runs = a + common.run_starts(root[a:b])
        if len(runs) < 2:
            continue
        size = np.diff(np.append(runs, b))
        big = int(size.argmax())
        inside = np.arange(runs[big], runs[big] + size[big])
        others = np.concatenate([np.arange(a, runs[big]), np.arange(runs[big] + size[big], b)])
        after = np.searchsorted(root[others], root[others], "right")  # the next component among the others
        for k, i in enumerate(others.tolist()):
            j = np.concatenate([inside, others[after[k] :]])
            j = j[_close(n[i], n[j])]
            j = j[_alike(bits, n, i, j)]
            if len(j):
                yield _ordered(node, n, np.full(len(j), i), j)


def grouped(docs: DataFrame, shingle: int = 5, tries: int = 32, turns: int = 1) -> DataFrame:
    """k_doc, th, node, root for every row of docs: rows with one root are near duplicates."""
    marked = common.checkpoint(nodes(docs, shingle, levels(docs, shingle)))
    rows = marked.drop("prefix", "parities")
    met = common.checkpoint(shared(marked))
    first = common.checkpoint(marked.groupBy("node").agg(F.min(F.struct("k_doc", "th")).alias("x"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("parities").alias("parities")).select("node", "n", "fp", "x.k_doc", "x.th", "parities"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets have similarity 0.8 or more."""
        pairs = common.checkpoint(pairs.select("a", "b").distinct())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        of = sets(docs, first.join(wanted, "node", "left_semi").select("k_doc", "th"), shingle)
        both = pairs.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b")
        near = both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb")))
        return common.checkpoint(near.select("a", "b"))

    # SimHash: links of fingerprints, between the least nodes that have them, and nodes of one fingerprint
    of_print = first.where("n > 0").groupBy("fp").agg(F.min("node").alias("node"))
    linked = simhash.links(of_print.select("fp")).toDF("fa", "fb").join(of_print.toDF("fa", "a"), "fa").join(of_print.toDF("fb", "b"), "fb").select("a", "b")
    same = first.where("n > 0").join(of_print.toDF("fp", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")

    def pairs(reached: DataFrame, list_pairs) -> DataFrame:
        """Candidates among the nodes that share a prefix shingle with a node of another component."""
        known = met.join(first.select("node", "parities"), "node").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = known.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
        dealt = known.join(mixed, "h", "left_semi").select("h", "node", "n", "root", "parities").repartition(common.partitions(docs.sparkSession), "h").sortWithinPartitions("h")
        return dealt.mapInArrow(candidates(list_pairs), _PAIRS).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))

    # none is linked yet: each node is its own component
    alone = first.select("node", F.col("node").alias("root")).limit(0)
    near = verified(reduce(DataFrame.unionByName, [pairs(alone, few_pairs(tries, turn)).select("a", "b") for turn in range(turns)], linked.unionByName(same)))
    reached = components(near)
    prefix = lambda n: F.col(n) - F.floor((4 * F.col(n) + 4) / 5) + 1
    behind = F.greatest(F.col("na") - prefix("na"), F.col("nb") - prefix("nb"))
    may = F.col("c") + behind >= F.floor((4 * (F.col("na") + F.col("nb")) + 8) / 9)
    reached = components(near.unionByName(verified(pairs(reached, across).where(may))))
    return rows.join(reached, "node", "left").select("k_doc", "th", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without near duplicates: of each component the row with the least doc_id stays (null
    ids last, then the least text hash), once if it repeats. Columns stay."""
    return common.least_of_each(docs, grouped(docs, shingle))
