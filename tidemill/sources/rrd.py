"""Round-robin files: a Spark data source for their rows, and whole files read and written.

Layout (little-endian, 64-bit): a head, the data sources, the archives, the time of the last update,
the open step of each source, the open row of each archive and source, each archive's newest row
number, then the rows of every archive as doubles in a ring.
"""

from __future__ import annotations

import fnmatch
import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource as SparkSource
from pyspark.sql.datasource import DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..schema import BASIC, Archive, Database, DataSource

#: Fixed values of the format.
COOKIE, FLOAT_COOKIE = b"RRD\0", 8.642135e130
HEAD, SOURCE, ARCHIVE, OPEN_STEP = "<4s5s7xdQQQ80s", "<20s20s80s", "<20s4xQQ80s", "<30s2x80s"
#: Where an archive's parameters stand among its ten words; True: a whole number.
PARAMS = {
    "HWPREDICT": {"alpha": (1, False), "beta": (2, False), "dependent": (3, True), "period": (4, True)},
    "MHWPREDICT": {"alpha": (1, False), "beta": (2, False), "dependent": (3, True), "period": (4, True)},
    "SEASONAL": {"gamma": (1, False), "smoothing_window": (2, False), "dependent": (3, True), "smooth_index": (4, True)},
    "DEVSEASONAL": {"gamma": (1, False), "smoothing_window": (2, False), "dependent": (3, True), "smooth_index": (4, True)},
    "DEVPREDICT": {"dependent": (3, True)},
    "FAILURES": {"delta_pos": (1, False), "delta_neg": (2, False), "dependent": (3, True), "window": (4, True), "threshold": (5, True)},
}
#: Bytes of rows that one task reads.
PARTITION_BYTES = 64_000_000

SCHEMA = "path string, series string, rra int, cf string, ts long, v double"


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


@dataclass
class Open:
    """The step that a data source is in."""

    last: str = "U"
    value: float = 0.0
    unknown: int = 0


@dataclass
class Header:
    db: Database
    version: str = "0003"
    open: list[Open] = field(default_factory=list)
    #: for each archive and source the ten words of the open row
    prep: list[list[bytes]] = field(default_factory=list)
    newest: list[int] = field(default_factory=list)
    size: int = 0

    def offset(self, index: int) -> int:
        n = len(self.db.sources)
        return self.size + 8 * n * sum(a.rows for a in self.db.archives[:index])

    def end(self, index: int) -> int:
        """Time of an archive's newest row."""
        slot = self.db.step * self.db.archives[index].pdp_per_row
        return self.db.last_update - self.db.last_update % slot


def parse(raw: bytes) -> Header:
    """The header of a file; raises ValueError where raw is no such file or is cut short."""
    try:
        cookie, version, mark, n_sources, n_archives, step, _ = struct.unpack_from(HEAD, raw)
        if cookie != COOKIE:
            raise ValueError("not a round-robin file")
        if mark != FLOAT_COOKIE:
            raise ValueError("written on another kind of machine")
        version = _text(version)
        if not version.isdigit() or not 1 <= int(version) <= 5:
            raise ValueError(f"unknown version {version!r}")
        at, sources, archives = struct.calcsize(HEAD), [], []
        for _ in range(n_sources):
            name, kind, par = struct.unpack_from(SOURCE, raw, at)
            heartbeat, (low, high) = struct.unpack_from("<Q", par)[0], struct.unpack_from("<dd", par, 8)
            known = lambda x: None if math.isnan(x) else x
            kind = _text(kind)
            plain = kind != "COMPUTE"
            sources.append(DataSource(_text(name), kind, heartbeat if plain else 0, known(low) if plain else None, known(high) if plain else None))
            at += struct.calcsize(SOURCE)
        for _ in range(n_archives):
            cf, rows, steps, par = struct.unpack_from(ARCHIVE, raw, at)
            cf = _text(cf)
            words = {k: struct.unpack_from("<Q" if whole else "<d", par, 8 * i)[0] for k, (i, whole) in PARAMS.get(cf, {}).items()}
            archives.append(Archive(cf, struct.unpack_from("<d", par)[0] if cf in BASIC else 0.0, steps, rows, words))
            at += struct.calcsize(ARCHIVE)
        last = struct.unpack_from("<q", raw, at)[0]
        at += 16 if int(version) >= 3 else 8
        out = Header(Database(step, tuple(sources), tuple(archives), None, last), version)
        for _ in range(n_sources):
            reading, scratch = struct.unpack_from(OPEN_STEP, raw, at)
            out.open.append(Open(_text(reading), struct.unpack_from("<d", scratch, 8)[0], struct.unpack_from("<Q", scratch)[0]))
            at += struct.calcsize(OPEN_STEP)
        for _ in range(n_archives):
            out.prep.append([raw[at + 80 * k : at + 80 * (k + 1)] for k in range(n_sources)])
            at += 80 * n_sources
        out.newest = list(struct.unpack_from(f"<{n_archives}Q", raw, at))
        out.size = at + 8 * n_archives
    except struct.error:
        raise ValueError("the header is cut short") from None
    return out


def header_size(raw: bytes) -> int:
    """From the first bytes: how many the header takes at most."""
    if len(raw) < struct.calcsize(HEAD):
        raise ValueError("the header is cut short")
    n, m = struct.unpack_from(HEAD, raw)[3:5]
    return struct.calcsize(HEAD) + struct.calcsize(SOURCE) * n + struct.calcsize(ARCHIVE) * m + 16 + struct.calcsize(OPEN_STEP) * n + 80 * n * m + 8 * m


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        first = f.read(struct.calcsize(HEAD))
        if first[:4] != COOKIE:
            raise ValueError(f"{path}: not a round-robin file")
        need, held = header_size(first), os.fstat(f.fileno()).st_size
        if need > held + 8:
            raise ValueError(f"{path}: the header is cut short")
        return parse(first + f.read(need - len(first)))


def ring(path: str, header: Header, index: int, first: int, count: int) -> np.ndarray:
    """Rows first.. of an archive, oldest is 0; rows x sources."""
    archive, n = header.db.archives[index], len(header.db.sources)
    start = (header.newest[index] + 1 + first) % archive.rows
    out = np.empty((count, n), "<f8")
    with open(path, "rb") as f:
        done = 0
        while done < count:  # twice at most: up to the ring's end and from its beginning
            part = min(count - done, archive.rows - start)
            f.seek(header.offset(index) + 8 * n * start)
            raw = f.read(8 * n * part)
            if len(raw) < 8 * n * part:
                raise ValueError(f"{path}: archive {index} is cut short")
            out[done : done + part] = np.frombuffer(raw, "<f8").reshape(part, n)
            done, start = done + part, 0
    return out


@dataclass
class Whole:
    """A file in memory: its header and the rows of each archive, oldest first."""

    header: Header
    rows: list[np.ndarray]


def read(path: str) -> Whole:
    h = read_header(path)
    return Whole(h, [ring(path, h, i, 0, a.rows) for i, a in enumerate(h.db.archives)])


def encode(whole: Whole) -> bytes:
    h, db, nan = whole.header, whole.header.db, math.nan
    out = [struct.pack(HEAD, COOKIE, h.version.encode().ljust(5, b"\0"), FLOAT_COOKIE, len(db.sources), len(db.archives), db.step, b"\0" * 80)]
    for s in db.sources:
        bound = [nan if x is None else x for x in (s.low, s.high)]
        out.append(struct.pack(SOURCE, s.name.encode(), s.kind.encode(), struct.pack("<Qdd", s.heartbeat, *bound).ljust(80, b"\0")))
    for a in db.archives:
        par = bytearray(80)
        struct.pack_into("<d", par, 0, a.xff)
        for k, (i, integral) in PARAMS.get(a.cf, {}).items():
            struct.pack_into("<Q" if integral else "<d", par, 8 * i, a.params.get(k, 0))
        out.append(struct.pack(ARCHIVE, a.cf.encode(), a.rows, a.pdp_per_row, bytes(par)))
    out.append(struct.pack("<qq", db.last_update or 0, 0)[: 16 if int(h.version) >= 3 else 8])
    out += [struct.pack(OPEN_STEP, o.last.encode()[:29], struct.pack("<Qd", o.unknown, o.value).ljust(80, b"\0")) for o in h.open]
    out += [word for prep in h.prep for word in prep]
    # oldest first is a ring whose newest row is the last
    out += [struct.pack("<Q", a.rows - 1) for a in db.archives]
    out += [np.ascontiguousarray(r, "<f8").tobytes() for r in whole.rows]
    return b"".join(out)


def empty_prep(known: float = math.nan, missing: int = 0) -> bytes:
    """The open row of a basic archive: its value so far, its unknown steps."""
    return struct.pack("<dQ6Qdd", known, missing, 0, 0, 0, 0, 0, 0, math.nan, math.nan)


def created(db: Database) -> Whole:
    """A new file: every row is unknown."""
    behind = (db.last_update or 0) % db.step
    n = len(db.sources)
    preps = []
    for a in db.archives:
        slot = a.pdp_per_row * db.step
        preps.append([empty_prep(math.nan, ((db.last_update or 0) - behind) % slot // db.step)] * n)
    header = Header(db, open=[Open("U", 0.0, behind) for _ in db.sources], prep=preps, newest=[a.rows - 1 for a in db.archives])
    return Whole(header, [np.full((a.rows, n), math.nan) for a in db.archives])


def filled(db: Database, points: DataFrame) -> Whole:
    """A file of one database's points (series, rra, ts, v); series is the data source. A file holds a
    fixed number of rows, which is what this collects."""
    whole = created(db)
    place = {s.name: k for k, s in enumerate(db.sources)}
    for i, a in enumerate(db.archives):
        slot, end = a.pdp_per_row * db.step, whole.header.end(i)
        got = points.where((F.col("rra") == i) & (F.col("ts") > end - a.rows * slot) & (F.col("ts") <= end) & F.col("v").isNotNull()).select("series", "ts", "v").toPandas()
        rows = a.rows - 1 - (end - got["ts"].to_numpy(np.int64)) // slot
        whole.rows[i][rows, got["series"].map(place).to_numpy(np.int64)] = got["v"].to_numpy(float)
    return whole


def names(path: str, recursive: bool = False) -> list[str]:
    """Round-robin files of a folder, or those that a pattern of names fits, sorted."""
    folder, pattern = (path, "*.rrd") if os.path.isdir(path) else (os.path.dirname(path) or ".", os.path.basename(path))
    walk = os.walk(folder) if recursive else [(folder, [], os.listdir(folder) if os.path.isdir(folder) else [])]
    return sorted(os.path.join(d, f) for d, _, files in walk for f in files if fnmatch.fnmatch(f, pattern))


def info(path: str) -> list[tuple[str, str]]:
    """What ``info`` shows: keys and values in order."""
    h = read_header(path)
    bound = lambda x: "NaN" if x is None or math.isnan(x) else f"{x:.10e}"
    out = [("filename", f'"{path}"'), ("rrd_version", f'"{h.version}"'), ("step", str(h.db.step)), ("last_update", str(h.db.last_update)), ("header_size", str(h.size))]
    for k, (s, o) in enumerate(zip(h.db.sources, h.open)):
        own = [("index", str(k)), ("type", f'"{s.kind}"')]
        if s.kind != "COMPUTE":
            own += [("minimal_heartbeat", str(s.heartbeat)), ("min", bound(s.low)), ("max", bound(s.high))]
        own += [("last_ds", f'"{o.last}"'), ("value", bound(o.value)), ("unknown_sec", str(o.unknown))]
        out += [(f"ds[{s.name}].{a}", b) for a, b in own]
    for i, a in enumerate(h.db.archives):
        own = [("cf", f'"{a.cf}"'), ("rows", str(a.rows)), ("cur_row", str(h.newest[i])), ("pdp_per_row", str(a.pdp_per_row))]
        if a.cf in BASIC:
            own.append(("xff", f"{a.xff:.10e}"))
            for k, prep in enumerate(h.prep[i]):
                v, n = struct.unpack_from("<dQ", prep)
                own += [(f"cdp_prep[{k}].value", bound(v)), (f"cdp_prep[{k}].unknown_datapoints", str(n))]
        else:
            own += [(k, f"{v:.10e}" if isinstance(v, float) else str(v)) for k, v in a.params.items() if k not in ("dependent", "period", "smooth_index")]
        out += [(f"rra[{i}].{x}", y) for x, y in own]
    return out


# the Spark data source


@dataclass
class Rows(InputPartition):
    path: str
    index: int
    first: int
    count: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.index, self.first))


class Reader(DataSourceReader):
    """One task for each archive of each file, several for a large one. Filters on path, archive,
    function and time decide which parts of which files are read at all."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.recursive = options["path"], options.get("recursive", "false").lower() == "true"
        self.equal: dict[str, set] = {}
        self.after, self.until = -math.inf, math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ())
            if isinstance(f, EqualTo) and column and column[0] in ("path", "rra", "cf", "series"):
                self.equal.setdefault(column[0], set()).add(f.value)
            elif column == ("ts",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.after = max(self.after, f.value - isinstance(f, GreaterThanOrEqual))
            elif column == ("ts",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.until = min(self.until, f.value - isinstance(f, LessThan))
            yield f  # Spark still checks each row

    def wanted(self, column: str, value) -> bool:
        return all(value == x for x in self.equal.get(column, ()))

    def partitions(self) -> list[Rows]:
        out = []
        for path in names(self.path, self.recursive):
            if not self.wanted("path", path):
                continue
            h = read_header(path)
            most = max(1, PARTITION_BYTES // (8 * max(1, len(h.db.sources))))
            for i, a in enumerate(h.db.archives):
                if not (self.wanted("rra", i) and self.wanted("cf", a.cf)):
                    continue
                slot, end = h.db.step * a.pdp_per_row, h.end(i)
                start = end - a.rows * slot
                first = 0 if self.after <= start else int((self.after - start) // slot)
                stop = a.rows if self.until >= end else int((self.until - start) // slot)
                out += [Rows(path, i, k, min(most, stop - k)) for k in range(first, max(first, stop), most)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h = read_header(partition.path)
        db, a = h.db, h.db.archives[partition.index]
        slot = db.step * a.pdp_per_row
        oldest = h.end(partition.index) - (a.rows - 1) * slot
        for k in range(0, partition.count, 100_000):
            n = min(100_000, partition.count - k)
            values = ring(partition.path, h, partition.index, partition.first + k, n)
            ts = pa.array(oldest + slot * np.arange(partition.first + k, partition.first + k + n), pa.int64())
            for s, v in zip(db.sources, values.T):
                if self.wanted("series", s.name):
                    columns = [pa.array([x] * n, t) for x, t in ((partition.path, pa.string()), (s.name, pa.string()), (partition.index, pa.int32()), (a.cf, pa.string()))]
                    v = np.ascontiguousarray(v)
                    yield pa.RecordBatch.from_arrays([*columns, ts, pa.array(v, mask=np.isnan(v))], ["path", "series", "rra", "cf", "ts", "v"])


class RrdSource(SparkSource):
    """``spark.read.format("rrd").load(path)``: path is a folder or a pattern that the driver and all
    executors see; option recursive walks folders."""

    @classmethod
    def name(cls) -> str:
        return "rrd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def load(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RrdSource)
    return spark.read.format("rrd").option("recursive", str(recursive).lower()).load(path)
