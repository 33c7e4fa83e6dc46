"""Line dedup by range-partitioned hashes.

A line's key is its text without white space at both ends and with A-Z in lower case. Keys of at
least ``min_chars`` code points that at least two documents hold are kept in the document with the
smallest id only. 128-bit hashes of the keys are dealt to partitions by ranges of the hash, sorted
by (hash, document, position) inside each, and one stream over the sorted rows finds every later
document's lines. What comes back is a compressed bitmap of kept lines for each document, no text.

Before the shuffle each batch settles what it can: of the documents in a batch that hold a key only
the smallest can be the first, so the others' lines are already known to go and only one document
per batch and key travels. A line that a third of all documents hold so reaches its range partition
once per batch.

Defined results: a null text is one empty line; a null doc_id sorts after all others; rows that
share a doc_id count as one document, and each gets its own bitmap; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common

_ROWS = "h1 long, h2 long, k_doc long, th long, pos binary, n_lines long"
_ROWS_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k_doc", pa.int64()), ("th", pa.int64()), ("pos", pa.binary()), ("n_lines", pa.int64())])
_DROPS_ARROW = pa.schema([("k_doc", pa.int64()), ("th", pa.int64()), ("pos", pa.binary()), ("n_lines", pa.int64())])
_KEEP_ARROW = pa.schema([("k_doc", pa.int64()), ("th", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])


def line_key(line: bytes) -> bytes:
    return line.strip(common.WORD_SPACE).lower()


def hash_lines(min_chars: int):
    """Documents in; a row for each (key, document) that may be a first occurrence, a row with the
    lines that are known to go, and a row with the number of lines of each document."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch["k_doc"].to_numpy(), batch["th"].to_numpy()
            seen: set[tuple[int, int]] = set()
            first: dict[bytes, dict[int, list[int]]] = {}
            gone: dict[int, list[int]] = {}
            lines_of: dict[int, int] = {}
            for row, text in enumerate(common.texts(batch["text"])):
                me = (int(ids[row]), int(hashes[row]))
                if me in seen:
                    continue
                seen.add(me)
                lines = text.split(b"\n")
                lines_of[row] = len(lines)
                for pos, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    held = first.setdefault(xxhash.xxh3_128_digest(key), {})
                    if not held:
                        held[row] = [pos]
                    elif row in held:
                        held[row].append(pos)
                    else:
                        best = ids[next(iter(held))]
                        if ids[row] > best:
                            gone.setdefault(row, []).append(pos)
                        else:
                            if ids[row] < best:
                                for other, at in held.items():
                                    gone.setdefault(other, []).extend(at)
                                held.clear()
                            held[row] = [pos]
            keys = np.frombuffer(b"".join(first), "<i8").reshape(-1, 2)
            width = [len(held) for held in first.values()]
            rows = np.array([row for held in first.values() for row in held], np.int64)
            pos = [np.array(at, "<u4").tobytes() for held in first.values() for at in held.values()]
            keys = np.repeat(keys, width, axis=0)
            # what needs no comparison is spread by the hash of its text
            own = np.array(list(lines_of), np.int64)
            out = [
                np.concatenate([keys[:, 0], hashes[own]]),
                np.concatenate([keys[:, 1], ids[own]]),
                np.concatenate([ids[rows], ids[own]]),
                np.concatenate([hashes[rows], hashes[own]]),
                pos + [np.array(gone.get(row, ()), "<u4").tobytes() for row in own.tolist()],
                pa.array([None] * len(rows) + list(lines_of.values()), pa.int64()),
            ]
            yield from common.batches(_ROWS_ARROW, out)

    return run


def stream_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, document, position) in; lines after the first document out."""
    last, first_doc = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch[c].to_numpy() for c in ("h1", "h2", "k_doc"))
        header = np.asarray(batch["n_lines"].is_valid())
        starts = common.run_starts(h1, h2, header)
        run = np.zeros(len(h1), np.int64)
        run[starts[1:]] = 1
        firsts = doc[starts].copy()
        if last == (h1[0], h2[0], header[0]):
            firsts[0] = first_doc
        run = np.cumsum(run)
        last, first_doc = (h1[-1], h2[-1], header[-1]), firsts[-1]
        out = np.flatnonzero(header | (doc != firsts[run]))
        yield batch.select(["k_doc", "th", "pos", "n_lines"]).take(pa.array(out)).cast(_DROPS_ARROW)


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, dropped = [], []
        for n, parts in zip(batch["n_lines"].to_pylist(), batch["pos"].to_pylist()):
            bits = np.ones(n, np.uint8)
            bits[np.frombuffer(b"".join(parts), "<u4")] = 0
            dropped.append(n - int(bits.sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield from common.batches(_KEEP_ARROW, [batch["k_doc"], batch["th"], batch["n_lines"], dropped, keep])


def keep_bits(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(k_doc, th, n_lines, n_dropped, keep): for each distinct row of docs the zlib-compressed
    bitmap of the lines to keep, first line in the highest bit."""
    n = common.partitions(docs.sparkSession)
    hashed = common.identified(docs).mapInArrow(hash_lines(min_chars), _ROWS)
    # n ranges of the hash's upper half: partition i holds the i-th n-th of all hashes
    at = F.shiftright(F.shiftrightunsigned("h1", 33) * F.lit(n), 31).cast("int")
    ranged = hashed.repartitionById(n, at).sortWithinPartitions("h1", "h2", F.col("n_lines").isNotNull(), "k_doc")
    drops = ranged.mapInArrow(stream_first, "k_doc long, th long, pos binary, n_lines long")
    per_doc = drops.groupBy("k_doc", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("pos"))
    return per_doc.mapInArrow(bitmaps, "k_doc long, th long, n_lines long, n_dropped long, keep binary")


def kept(text: bytes, bitmap: bytes, n_lines: int) -> bytes:
    bits = keep_bits(bitmap, n_lines)
    return text if bits.all() else b"\n".join(x for x, k in zip(text.split(b"\n"), bits) if k)


def digests(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(common.texts(batch["text"]), batch["keep"].to_pylist(), batch["n_lines"].to_pylist())
            out = [hashlib.sha256(kept(*x)).hexdigest() for x in each]
            yield from common.batches(schema, [batch["doc_id"], batch["n_lines"], batch["n_dropped"], out])

    rows = common.identified(docs, F.col("doc_id").cast("long").alias("doc_id")).join(keep_bitmaps(docs, min_chars), ["k_doc", "th"])
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def deduplicated(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the dropped lines cut out of its texts; all rows and all columns stay, n_chars
    (if there) follows the text. A null text stays null."""
    plain = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = common.identified(docs, F.struct(*[F.col(f"`{c}`") for c in plain]).alias("tm_row")).join(keep_bitmaps(docs, min_chars), ["k_doc", "th"])
    out = rows.select("tm_row", F.when(F.col("text").isNotNull(), kept_text("text", "keep", "n_lines")).alias("tm_text"))
    columns = {c: F.col("tm_row").getField(c) for c in plain} | {"text": F.col("tm_text"), "n_chars": F.char_length("tm_text").cast("long")}
    return out.select(*[columns[c].alias(c) for c in docs.columns])


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, keep: pd.Series, n_lines: pd.Series) -> pd.Series:
    each = zip(text, keep, n_lines)
    return pd.Series([None if t is None else kept(t.encode(), k, n).decode() for t, k, n in each])
