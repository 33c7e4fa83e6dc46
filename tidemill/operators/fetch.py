"""Fetching: the best archive for a window, and a dense grid of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BASIC, Database

#: Rows of one series that a collected fetch gives at most.
MAX_ROWS = 10_000_000


def choose_archive(db: Database, cf: str, start: int, end: int, step: int) -> int:
    """Index of the archive to read: of those that reach back to start the one with the nearest
    step; if none does, the one that covers most of the window, then the nearest step. Archives of
    one PDP a row serve every basic function."""
    fitting = [(i, a) for i, a in enumerate(db.archives) if a.cf == cf or (a.pdp_per_row == 1 and a.cf in BASIC and cf in BASIC)]
    if not fitting:
        raise ValueError(f"no archive consolidates by {cf}")

    def began(a) -> int:
        slot = db.step * a.pdp_per_row
        return db.last_update - db.last_update % slot - slot * a.rows

    def off(a) -> int:
        return abs(db.step * a.pdp_per_row - step)

    whole = [(i, a) for i, a in fitting if began(a) <= start]
    if whole:
        return min(whole, key=lambda x: (off(x[1]), x[0]))[0]
    return min(fitting, key=lambda x: (began(x[1]), off(x[1]), x[0]))[0]


def window(start: int, end: int, step: int) -> tuple[int, int]:
    """The fetched window: start down to a boundary, end to the next boundary after it."""
    return start - start % step, end - end % step + step


def align_start(start: int, end: int, step: int) -> tuple[int, int]:
    return start - start % step, end


def grid(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """ts of every row in (start, end]."""
    return spark.range(start + step, end + 1, step).select(F.col("id").alias("ts"))


def fetch(points: DataFrame, db: Database, cf: str, start: int, end: int, step: int = 1, keys: tuple[str, ...] = ("series",), limit: int | None = MAX_ROWS, series: list[str] | None = None) -> tuple[DataFrame, int, int, int]:
    """(rows, first boundary, end, step). rows: keys, ts, v; what the archive lacks is unknown.

    points: keys, rra, ts, v. The archive and the window are filters on points, so they reach the
    scan of a stored table. series: the values of a single key, where they are known, as data sources
    are; without it points are read once more to tell which series there are.
    """
    index = choose_archive(db, cf, start, end, step)
    slot = db.step * db.archives[index].pdp_per_row
    first, last = window(start, end, slot)
    count = (last - first) // slot
    if limit is not None and count > limit:
        raise ValueError(f"{count} rows are more than {limit}")
    stored = points.where((F.col("rra") == index) & (F.col("ts") > first) & (F.col("ts") <= last))
    # every series has every row of the grid: the rows that a fetch returns, not a join of keys
    if series is not None:
        (key,) = keys
        dense = grid(points.sparkSession, first, last, slot).select(F.explode(F.array(*map(F.lit, series))).alias(key), "ts")
    else:
        told = points.where(F.col("rra") == index).select(*keys).distinct()
        dense = told.withColumn("ts", F.explode(F.sequence(F.lit(first + slot), F.lit(last), F.lit(slot))))
    rows = dense.join(stored.select(*keys, "ts", "v"), [*keys, "ts"], "left")
    return rows, first, last, slot


def first_time(db: Database, index: int = 0) -> int:
    slot = db.step * db.archives[index].pdp_per_row
    return db.last_update - db.last_update % slot - (db.archives[index].rows - 1) * slot


def last_updates(readings: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys, last, reading: the newest reading of each series."""
    return readings.groupBy(*keys).agg(F.max("ts").alias("last"), F.max_by("v", F.struct("ts", "seq") if "seq" in readings.columns else "ts").alias("reading"))
