"""The twelve aggregates over a whole series: value and, for some, a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the functions.
FUNCTIONS = ("MAXIMUM", "MINIMUM", "AVERAGE", "STDEV", "LAST", "FIRST", "TOTAL", "PERCENT", "PERCENTNAN", "LSLSLOPE", "LSLINT", "LSLCORREL")


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _percentile(series: DataFrame, p: float, known_only: bool, keys: tuple[str, ...]) -> DataFrame:
    rows = series.where("v is not null") if known_only else series
    w = Window.partitionBy(*keys)
    # unknown sorts first; the element at round(p * (n - 1) / 100), halves up
    ranked = rows.withColumn("_k", F.row_number().over(w.orderBy(F.col("v").asc_nulls_first())) - 1).withColumn("_n", F.count("*").over(w))
    at = F.floor(F.lit(p) * (F.col("_n") - 1) / 100 + 0.5)
    return ranked.where(F.col("_k") == at).select(*keys, F.col("v").alias("value"), F.lit(None).cast("long").alias("time"))


def vdef(series: DataFrame, function: str, step: int, parameter: float | None = None, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys, value, time. series: keys, ts (end of the row), v; all rows of the window present."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown VDEF function {function!r}")
    if function.startswith("PERCENT"):
        if parameter is None or not 0 <= parameter <= 100:
            raise ValueError("a percentile is from 0 to 100")
        found = _percentile(series, parameter, function == "PERCENTNAN", keys)
        all_keys = series.select(*keys).distinct()
        return all_keys.join(found, list(keys), "left").select(*keys, "value", "time")
    v, ts, f = F.col("v"), F.col("ts"), finite(F.col("v"))
    none = F.lit(None).cast("long")
    known = v.isNotNull()
    if function in ("LSLSLOPE", "LSLINT", "LSLCORREL"):
        # one aggregate: rows counted in whole steps (exact), their mean and squares about the mean
        k = F.when(f.isNotNull(), F.floor(ts / F.lit(step)))
        wide = lambda c: F.sum(c.cast("decimal(38,0)"))
        sums = series.groupBy(*keys).agg(F.min(F.floor(ts / F.lit(step))).alias("k0"), F.count(f).alias("n"), wide(k).alias("sk"), wide(k * k).alias("skk"), F.sum(f).alias("sy"), F.sum(f * f).alias("syy"), F.covar_pop(k.cast("double"), f).alias("cov"))
        n, sy, k0 = F.col("n"), F.col("sy"), F.col("k0")
        # integers until the first row's place is taken off, as the places are large numbers
        sx = (F.col("sk") - (n * k0).cast("decimal(38,0)")).cast("double")
        sxx = (F.col("skk") - 2 * k0.cast("decimal(19,0)") * F.col("sk") + (n * k0 * k0).cast("decimal(38,0)")).cast("double")
        sxy = n * F.col("cov") + sx * sy / n
        syy = F.col("syy")
        over = n * sxx - sx * sx
        slope = F.when(over != 0, (n * sxy - sx * sy) / over)
        both = over * (n * syy - sy * sy)
        value = {"LSLSLOPE": slope, "LSLINT": F.when(n > 0, (sy - slope * sx) / n), "LSLCORREL": F.when(both > 0, (n * sxy - sx * sy) / F.sqrt(both))}[function]
        return sums.select(*keys, value.alias("value"), none.alias("time"))
    if function in ("MAXIMUM", "MINIMUM"):
        # the best finite value and its first time; an infinite first value only if nothing is finite
        order = F.struct(f.alias("v"), (-ts).alias("t")) if function == "MAXIMUM" else F.struct(f.alias("v"), ts.alias("t"))
        best = (F.max if function == "MAXIMUM" else F.min)(F.when(f.isNotNull(), order))
        rows = series.groupBy(*keys).agg(best.alias("b"), F.min(F.when(known, F.struct(ts.alias("t"), v.alias("v")))).alias("f"))
        return rows.select(*keys, F.coalesce("b.v", "f.v").alias("value"), F.coalesce(F.abs("b.t"), "f.t").alias("time"))
    if function in ("FIRST", "LAST"):
        pick = (F.min if function == "FIRST" else F.max)(F.when(known, F.struct(ts.alias("t"), v.alias("v"))))
        rows = series.groupBy(*keys).agg(pick.alias("b"))
        return rows.select(*keys, F.col("b.v").alias("value"), (F.col("b.t") - (step if function == "FIRST" else 0)).alias("time"))
    agg = {"AVERAGE": F.avg(f), "TOTAL": F.sum(f) * step, "STDEV": F.stddev_pop(f)}[function]
    return series.groupBy(*keys).agg(agg.alias("value")).select(*keys, "value", none.alias("time"))


def all_functions(series: DataFrame, step: int, percentile: float = 95, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    return reduce(DataFrame.unionByName, [vdef(series, f, step, percentile, keys).select(*keys, F.lit(f).alias("function"), "value", "time") for f in FUNCTIONS])
