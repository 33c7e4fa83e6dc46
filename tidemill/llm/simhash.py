"""SimHash near-dedup with pivot distance tables.

A document's fingerprint has bit i set if bit i is set in over half of the XXH64 hashes of its word
shingles. Two fingerprints link if at most ``max_bits`` bits differ.

Each distinct fingerprint gets its row of the pivot distance table: its Hamming distances to
``PIVOTS`` reference fingerprints. By the triangle inequality a pair at distance <= d differs by at
most d in every coordinate, so pairs whose maximum coordinate difference is larger are discarded
and only survivors are verified bit by bit. Distances to a random reference vary by a few bits only
(their standard deviation is 4), so the table alone would leave pairs to be looked at all over the
input; rows are therefore brought together by the pigeonhole principle first: of six blocks of a
fingerprint at least two agree in any pair with up to four differing bits (of seven three, of eight
four: the longer keys of larger inputs). The table then works
inside each group of rows that agree in two blocks, sorted by the first coordinate, so that a row
is only held against the window of rows within max_bits of it.

Copies share a fingerprint and count once. A group never lists its pairs: it passes on a spanning
forest of its links. Groups over ``hot`` rows are cut into slices and every pair of slices becomes
a task of its own, so no group has to fit in one task. Where rows meet their fingerprint's component,
fingerprints and components of many rows are dealt over several tasks too.

Defined results: a null or wordless text has fingerprint 0 and links like any other; a bit that
exactly half the hashes have is 0; texts of any length are read whole; a null doc_id takes part but is
never a component's id unless all its ids are null (then it is null); repeated rows stay; without
documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, unite

PIVOTS = 24
SEED = 42


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Of every shingle in turn; fewer words than a shingle has are one shingle."""
    if not words:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    h, digest = np.empty(n, "<u8"), xxhash.xxh64_intdigest
    h[:] = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    return h


def fingerprint(text: bytes, shingle: int = 4) -> int:
    return of_hashes(shingle_hashes(text.lower().split(), shingle))


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of a text's shingles."""
    n = len(h)
    if n <= 1:
        return int(h[0]) if n else 0
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = h[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """k_doc, th, fp (the 64 bits as a long) for every row of docs."""
    schema = pa.schema([("k_doc", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in common.texts(batch["text"])], np.uint64)
            yield from common.batches(schema, [batch["k_doc"], batch["th"], fp.view(np.int64)])

    return common.identified(docs).mapInArrow(run, "k_doc long, th long, fp long")


def link_groups(max_bits: int):
    """Rows (key, bi, bj, slice, fp) sorted by group in; links of a spanning forest out."""
    table_of, schema = pivots(), pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def forest(group, cut, fp) -> tuple[np.ndarray, np.ndarray]:
        distance = np.bitwise_count(fp[:, None] ^ table_of[None, :]).astype(np.int8)
        order = np.lexsort((distance[:, 0], group))
        group, cut, fp, distance = group[order], cut[order], fp[order], distance[order]
        root = np.arange(len(fp))
        live, step = np.arange(len(fp) - 1), 1
        while len(live):
            live = live[live + step < len(fp)]
            other = live + step
            near = (group[live] == group[other]) & (distance[other, 0] - distance[live, 0] <= max_bits)
            live, other = live[near], other[near]
            step += 1
            i, j = live, other
            ask = (cut[i] < 0) | (cut[i] != cut[j])  # of two slices only pairs across them are new
            i, j = i[ask], j[ask]
            for k in range(1, table_of.size, 4):
                far = np.abs(distance[i, k : k + 4] - distance[j, k : k + 4]).max(axis=1, initial=0)
                i, j = i[far <= max_bits], j[far <= max_bits]
            same = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            i, j = i[same], j[same]
            unite(root, i, j)
        at = np.flatnonzero(root != np.arange(len(fp)))
        return fp[at], fp[root[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False) for c in ("key", "bi", "bj", "cut", "fp")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            starts = common.run_starts(*now[:3])
            if not len(starts):
                continue
            # the last group may go on in the next batch
            done, held = [x[: starts[-1]] for x in now], [x[starts[-1] :] for x in now]
            yield from emit(done)
        if held is not None:
            yield from emit(held)

    def emit(rows) -> Iterator[pa.RecordBatch]:
        if not len(rows[0]):
            return
        starts = common.run_starts(*rows[:3])
        sizes = np.diff(np.append(starts, len(rows[0])))
        group = np.repeat(np.arange(len(starts)), sizes)
        many = np.repeat(sizes > 1, sizes)
        # in a group that is one slice against itself (cut -1) all pairs count
        a, b = forest(group[many], np.where(rows[1] == rows[2], -1, rows[3])[many], rows[4].view(np.uint64)[many])
        yield from common.batches(schema, [a.view(np.int64), b.view(np.int64)])

    return run


def blocks_for(nodes: int) -> tuple[int, int]:
    """(blocks, how many of them have to agree): more and longer keys for more fingerprints, so that
    the rows of a key stay few. The pairs found are the same."""
    return (6, 2) if nodes <= 1 << 25 else (7, 3) if nodes <= 1 << 30 else (8, 4)


def keys(of_blocks: int, agree: int) -> list:
    """A key for every choice of so many blocks, as columns over fp."""
    widths = [len(x) for x in np.array_split(np.arange(64), of_blocks)]
    at = np.cumsum((0, *widths)).tolist()
    block = [F.shiftrightunsigned("fp", at[i]).bitwiseAND(F.lit((1 << w) - 1)) for i, w in enumerate(widths)]
    out = []
    for t, chosen in enumerate(combinations(range(of_blocks), agree)):
        key = F.lit(t).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]) + block[i]
        out.append(key)
    return out


def links(nodes: DataFrame, max_bits: int = 4, hot: int = 1024, blocks: tuple[int, int] | None = None) -> DataFrame:
    """Distinct fingerprints (fp long) in; links (a, b) that connect whatever is within max_bits.
    hot: rows of a key that one task holds at most, or a fair share of all rows where that is more."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the blocks find pairs of up to four differing bits")
    n = nodes.count()
    of_blocks, agree = blocks or blocks_for(n)
    each = keys(of_blocks, agree)
    keyed = nodes.select("fp", F.explode(F.array(*each)).alias("key"))
    most = max(hot, n * len(each) // (8 * common.partitions(nodes.sparkSession)))
    # at most 8 keys for each partition are so large: their list goes to every task
    large = keyed.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / F.lit(most // 2)).cast("int").alias("s"))
    cut = keyed.join(F.broadcast(large), "key", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    pair = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    pair = pair.select("key", F.least("cut", "o").alias("bi"), F.greatest("cut", "o").alias("bj"), "cut", "fp")
    dealt = pair.repartition(common.partitions(nodes.sparkSession), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return dealt.mapInArrow(link_groups(max_bits), "a long, b long")


def grouped(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """k_doc, th, fp, root, least for every row of docs: rows with one root are near duplicates and
    least is the least k_doc among them."""
    spark = docs.sparkSession
    prints = common.checkpoint(fingerprints(docs, shingle))
    own = common.checkpoint(prints.groupBy("fp").agg(F.min("k_doc").alias("least"), F.count("*").alias("n")))
    # signed order of fingerprints is as good as any for naming components
    reached = components(links(own.select("fp"), max_bits))
    known = own.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = known.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("members"))
    rows, members = own.agg(F.sum("n"), F.count("*")).first()
    by_print = common.join_spread(known.drop("least"), roots, "root", "members", common.fair_share(spark, members or 0))
    return common.join_spread(prints, by_print, "fp", "n", common.fair_share(spark, rows or 0)).select("k_doc", "th", "fp", "root", "least")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id of all documents that
    links reach) for every row of docs."""
    real = lambda c: F.when(F.col(c) != common.NULL_DOC, F.col(c))
    return grouped(docs, shingle, max_bits).select(real("k_doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real("least").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, max_bits: int = 4) -> DataFrame:
    """docs without near duplicates: of each component the row with the least doc_id stays (null
    ids last, then the least text hash), once if it repeats. Columns stay."""
    return common.least_of_each(docs, grouped(docs, shingle, max_bits))
