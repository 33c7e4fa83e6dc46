"""Maintenance: new archives filled from old ones, other retentions, other steps."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BASIC, Archive, Database, DataSource
from .consolidate import consolidated


def backfilled(points: DataFrame, db: Database, archive: Archive, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys, ts, v for an archive added to a database that has rows: from archives of AVERAGE or
    of its own function that are at least as fine and divide it, the finest with a value first."""
    slot = archive.pdp_per_row * db.step
    from_ = [(i, a) for i, a in enumerate(db.archives) if a.cf in ("AVERAGE", archive.cf) and a.cf in BASIC and archive.pdp_per_row % a.pdp_per_row == 0]
    if not from_:
        raise ValueError("no archive to fill the new one from")
    from_.sort(key=lambda x: (x[1].pdp_per_row, x[1].cf != archive.cf, x[0]))
    end = F.ceil(F.col("ts") / F.lit(slot)) * slot
    parts = []
    for rank, (i, a) in enumerate(from_):
        k = archive.pdp_per_row // a.pdp_per_row
        rows = points.where(F.col("rra") == i).groupBy(*keys, end.alias("te")).agg(consolidated(archive.cf).alias("v"), F.count("v").alias("n"))
        parts.append(rows.select(*keys, "te", F.when(k - F.col("n") <= archive.xff * k, F.col("v")).alias("v"), F.lit(rank).alias("rank")))
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy(*keys, "te").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("rank"))).alias("v"))
    # a row stands when its interval is over: the newest step of the finest archive tells
    newest = points.where(F.col("rra") == from_[0][0]).groupBy(*keys).agg((F.floor(F.max("ts") / F.lit(slot)) * slot).alias("last"))
    return best.join(newest, list(keys)).where((F.col("te") <= F.col("last")) & (F.col("te") > F.col("last") - archive.rows * slot)).select(*keys, F.col("te").alias("ts"), "v")


def resized(points: DataFrame, db: Database, index: int, rows: int, keys: tuple[str, ...] = ("series",)) -> tuple[DataFrame, Database]:
    """The archive with so many rows more (fewer if negative): the newest stay, added ones are
    unknown and so not stored."""
    changed = db.resized(index, rows)
    slot = db.step * db.archives[index].pdp_per_row
    keep = changed.archives[index].rows * slot
    last = points.where(F.col("rra") == index).groupBy(*keys).agg(F.max("ts").alias("_last"))
    kept = points.join(last, list(keys), "left").where((F.col("rra") != index) | (F.col("ts") > F.col("_last") - keep)).drop("_last")
    return kept, changed


def without_archive(points: DataFrame, index: int) -> DataFrame:
    """Rows without one archive; later ones move up."""
    return points.where(F.col("rra") != index).withColumn("rra", F.when(F.col("rra") > index, F.col("rra") - 1).otherwise(F.col("rra")))


def without_source(points: DataFrame, name: str, column: str = "series") -> DataFrame:
    return points.where(F.col(column) != name)


def renamed(points: DataFrame, old: str, new: str, column: str = "series") -> DataFrame:
    return points.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def restructured(db: Database, points: DataFrame, rename: dict[str, str] | None = None, remove_sources: tuple[str, ...] = (), add_sources: tuple[DataSource, ...] = (), resize: dict[int, int] | None = None, remove_archives: tuple[int, ...] = (), keys: tuple[str, ...] = ("series",), column: str = "series") -> tuple[Database, DataFrame]:
    """(definition, points) after several changes at once. Archives are named by their places before
    the call; resize: rows more or fewer. A source that is added has no rows yet: all its values are
    unknown. Everything is checked before a row is touched."""
    names = [s.name for s in db.sources]
    for n in (*(rename or {}), *remove_sources):
        if n not in names:
            raise ValueError(f"unknown data source name {n!r}")
    for i in (*(resize or {}), *remove_archives):
        if not 0 <= i < len(db.archives):
            raise ValueError(f"there is no archive {i}")
    sources = [replace(s, name=(rename or {}).get(s.name, s.name)) for s in db.sources if s.name not in remove_sources] + list(add_sources)
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("a DS name occurs twice")
    if not sources or len(set(remove_archives)) == len(db.archives):
        raise ValueError("a database has at least one DS and one RRA")
    for i, rows in (resize or {}).items():
        points, db = resized(points, db, i, rows, keys)
    points = points.where(~F.col(column).isin(*remove_sources)) if remove_sources else points
    if rename:
        to = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])
        points = points.withColumn(column, F.coalesce(to[F.col(column)], F.col(column)))
    kept = [i for i in range(len(db.archives)) if i not in remove_archives]
    place = F.create_map(*[F.lit(x) for new, old in enumerate(kept) for x in (old, new)])
    points = points.withColumn("rra", place[F.col("rra")]).where("rra is not null")
    return replace(db, sources=tuple(sources), archives=tuple(db.archives[i] for i in kept)), points


def prefilled(points: DataFrame, source: Database, new: Database) -> DataFrame:
    """The rows of a database that is created from one that exists: both have the same sources and
    archives, and the new one starts where the old one ended. Another step needs a source without a
    known value."""
    if new.start is not None and new.start != source.last_update:
        raise ValueError("the new database starts at the last update of its source")
    if new.sources != source.sources:
        raise ValueError("the data sources of both databases are to be the same")
    if new.archives != source.archives:
        raise ValueError("the archives of both databases are to be the same")
    if new.step != source.step:
        if points.where("v is not null").limit(1).count():
            raise ValueError("another step needs a source that holds no value")
        return points.limit(0)
    return points


def written(points: DataFrame, db: Database, before: int, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys, ts, cf, pdp_per_row, v: the archive rows that updates after the time ``before`` wrote,
    as the summary of an update command lists them."""
    slots = F.create_map(*[F.lit(x) for i, a in enumerate(db.archives) for x in (i, a.pdp_per_row * db.step)])
    first = F.floor(F.lit(before) / slots[F.col("rra")]) * slots[F.col("rra")]
    cf = F.create_map(*[F.lit(x) for i, a in enumerate(db.archives) for x in (i, a.cf)])
    k = F.create_map(*[F.lit(x) for i, a in enumerate(db.archives) for x in (i, a.pdp_per_row)])
    return points.where(F.col("ts") > first).select(*keys, "ts", cf[F.col("rra")].alias("cf"), k[F.col("rra")].alias("pdp_per_row"), "v")
