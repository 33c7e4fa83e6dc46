"""Helpers shared by the corpus operators: identities, text buffers, blobs, checkpoints."""

from __future__ import annotations

import ctypes
import functools
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id wherever documents are ordered: it sorts after every real id.
NULL_DOC = (1 << 63) - 1

#: What separates words in the whole subpackage: the six ASCII white-space characters.
WORD_SPACE = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. Only a local session may go without, as
    in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-checkpoint-"))


def word_hash(word: str) -> int:
    """64 bits of a word, as a signed number."""
    return (xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) ^ (1 << 63)) - (1 << 63)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which survives lost executors."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """(k_doc, th, text, more...): the columns that the operators need, under names of their own.

    k_doc orders documents (null ids last), (k_doc, th) identifies a row: rows that agree in both
    have the same id and text and so the same result. Other columns of docs, whatever their
    names, never get in the way.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("k_doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


def row_of(docs: DataFrame):
    """All columns of docs as one."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def rows_of(df: DataFrame, column: str, columns: list[str]) -> DataFrame:
    """The columns that row_of() put into one."""
    return df.select(*[F.col(column).getField(c).alias(c) for c in columns])


def join_spread(rows: DataFrame, one: DataFrame, key: str, n: str, most: int, how: str = "inner") -> DataFrame:
    """rows joined by key with one, which has a row for each key and in n how many of rows have it.

    Keys of more than ``most`` rows are dealt over several tasks, by a hash of the whole row, and
    their row of one goes to each. There are at most (all rows) / most such keys; callers give a
    most that is a fixed part of a task's fair share, so that the list is bounded and is broadcast."""
    salts = F.ceil(F.col(n) / F.lit(most)).cast("int")
    hot = F.broadcast(one.where(F.col(n) > most).select(key, salts.alias("tm_salts")))
    dealt = rows.join(hot, key, "left").withColumn("tm_salt", F.when(F.col("tm_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("tm_salts")).cast("int"))).drop("tm_salts")
    copies = one.withColumn("tm_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > most, salts - 1).otherwise(0)))).drop(n)
    return dealt.join(copies, [key, "tm_salt"], how).drop("tm_salt")


def fair_share(spark: SparkSession, rows: int, part: int = 8) -> int:
    """A part of the rows that a task gets if all get the same, but not few."""
    return max(1000, rows // (part * partitions(spark)))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def least_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with the least (k_doc, th) of each root in rows (k_doc, th, root), once if it repeats: of
    rows with one id and text that differ elsewhere the one with the least hash of all columns."""
    first = rows.groupBy("root").agg(F.min(F.struct("k_doc", "th")).alias("x")).select("x.k_doc", "x.th")
    own = identified(docs, row_of(docs).alias("tm_row")).drop("text").withColumn("tm_mix", F.xxhash64("tm_row"))
    kept = own.join(first, ["k_doc", "th"], "left_semi").groupBy("k_doc", "th").agg(F.min_by("tm_row", "tm_mix").alias("tm_row"))
    return rows_of(kept, "tm_row", docs.columns)


#: Bytes of text in a block of documents.
BLOCK_BYTES = 4_000_000


def text_bytes(docs: DataFrame) -> int:
    return int(docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents dealt into blocks of about block_bytes by a hash of their identity.

    Within a block rows sort by (k_doc, th), so a document has the same place in its block each
    time the block is computed; later passes name it by (block, place) alone.
    """
    rows = identified(docs)
    n = max(1, text_bytes(docs) // block_bytes)
    return rows.withColumn("block", F.pmod(F.xxhash64("k_doc", "th"), F.lit(n)).cast("int"))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def texts(column) -> Iterator[bytes]:
    """The rows of a string column as UTF-8; a null is empty."""
    data, offsets = text_buffers(column)
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(view[a:b])


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed blob."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        kind, raw = (b"bytes", bytes(a)) if isinstance(a, (bytes, bytearray)) else (a.dtype.str.encode(), np.ascontiguousarray(a).tobytes())
        out.append(struct.pack("<6sQ", kind, len(raw)) + raw)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, size = struct.unpack_from("<6sQ", raw, at)
        at += 14
        kind = kind.rstrip(b"\0")
        out.append(raw[at : at + size] if kind == b"bytes" else np.frombuffer(raw, kind.decode(), size // np.dtype(kind.decode()).itemsize, at))
        at += size
    return out


def table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def batches(schema: pa.Schema, columns: list) -> Iterator[pa.RecordBatch]:
    yield from table(schema, columns).to_batches(max_chunksize=50_000)


def tidy(f: Callable) -> Callable:
    """f, a function of batches, handing back at its end what its worker would keep: workers live from
    stage to stage and their free memory counts beside that of the next one."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library has it
            trim(0)

    return run


def in_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
