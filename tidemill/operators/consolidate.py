"""PDPs to archive rows: several resolutions, each with its function, tolerance and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BASIC, Archive


def consolidated(cf: str, v: str = "v", ts: str = "ts") -> Column:
    """Over the known values; LAST is the newest one, known or not."""
    return {"AVERAGE": F.avg(v), "MIN": F.min(v), "MAX": F.max(v), "LAST": F.max_by(v, ts)}[cf]


def archive_rows(pdp: DataFrame, archive: Archive, step: int, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys, ts (end of the row), v of one archive; steps that pdp lacks count as unknown, a row
    that is not over yet is left out and only the newest ``rows`` stay."""
    if archive.cf not in BASIC:
        raise ValueError(f"{archive.cf} rows come from operators.forecast")
    k, slot = archive.pdp_per_row, archive.pdp_per_row * step
    last = F.max("ts")
    if k == 1:
        rows = pdp.select(*keys, "ts", "v")
        ends = rows.groupBy(*keys).agg(last.alias("_last"))
    else:
        end = F.ceil(F.col("ts") / F.lit(slot)) * slot
        rows = pdp.groupBy(*keys, end.alias("slot_end")).agg(consolidated(archive.cf).alias("v"), F.count("v").alias("known"), last.alias("newest"))
        ends = rows.groupBy(*keys).agg(F.max("newest").alias("_last"))
        rows = rows.select(*keys, F.col("slot_end").alias("ts"), F.when(k - F.col("known") <= archive.xff * k, F.col("v")).alias("v"))
    newest = F.floor(F.col("_last") / F.lit(slot)) * slot
    return rows.join(ends, list(keys)).where((F.col("ts") <= newest) & (F.col("ts") > newest - archive.rows * slot)).select(*keys, "ts", "v")


def consolidate(pdp: DataFrame, archives: list[Archive], step: int, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys, rra, cf, ts, v: all archives of a database."""
    parts = [archive_rows(pdp, a, step, keys).select(*keys, F.lit(i).alias("rra"), F.lit(a.cf).alias("cf"), "ts", "v") for i, a in enumerate(archives) if a.cf in BASIC]
    return reduce(DataFrame.unionByName, parts)


def reduced(series: DataFrame, step: int, wanted: int, cf: str, start: int, end: int, keys: tuple[str, ...] = ("series",)) -> tuple[DataFrame, int]:
    """A stored series (start, end] at a coarser step: the least multiple of step >= wanted. Rows
    that the series covers in part are unknown; here LAST is the last known value."""
    factor = -(-wanted // step)
    if factor <= 1:
        return series, step
    new = factor * step
    at = F.ceil(F.col("ts") / F.lit(new)) * new
    value = F.max_by("v", F.when(F.col("v").isNotNull(), F.col("ts"))) if cf == "LAST" else consolidated(cf)
    rows = series.groupBy(*keys, at.alias("ts")).agg(value.alias("v"))
    return rows.select(*keys, "ts", F.when((F.col("ts") - new >= start) & (F.col("ts") <= end), F.col("v")).alias("v")), new
