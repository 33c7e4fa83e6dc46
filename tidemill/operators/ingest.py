"""Readings to primary data points (PDPs): one value for each step of each series.

A PDP is the time-weighted mean of the rates that readings gave during its step. Everything is
window functions and one aggregation by (series, step); only the rows that a long gap opens are
generated, and not beyond the retention horizon when one is given.

Windows are over spans of a series, not over whole series: few series with many readings would leave
all of one to a single task. A span hands its last reading on to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DataSource

#: What a counter that fell is taken to have wrapped by, first and second try.
WRAP_32, WRAP_64 = 4294967295, 18446744069414584320
#: Seconds of a span: at most so many readings of a series are in one.
SPAN = 86400


def _amount(kind: str, v: Column, old: Column, seconds: Column) -> tuple[Column, Column]:
    """(amount, the rate that bounds apply to)."""
    exact, before = v.try_cast("decimal(38,0)"), old.try_cast("decimal(38,0)")
    x, y = v.try_cast("double"), old.try_cast("double")
    if kind == "GAUGE":
        return x * seconds, x
    if kind == "ABSOLUTE":
        amount = x
    elif kind == "COUNTER":
        d = exact - before
        once = d + F.lit(WRAP_32)
        amount = F.when(d >= 0, d).when(once >= 0, once).otherwise(once + F.lit(str(WRAP_64)).cast("decimal(38,0)")).cast("double")
        amount = F.when(exact >= 0, amount)
    elif kind == "DERIVE":
        amount = F.when((exact < 0) == (before < 0), (exact - before).cast("double"))
    else:
        amount = x - y
        if kind == "DCOUNTER":
            amount = F.when(~(((amount < 0) & (x > 0)) | ((amount > 0) & (x < 0))), amount)
    return amount, amount / seconds


def _with_last(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, ts, v, prev, old: each reading (keys, ts, v; one a second) and the one before it."""
    rows = rows.where("ts is not null").select(*keys, F.floor(F.col("ts") / F.lit(SPAN)).alias("_span"), "ts", "v")
    ends = rows.groupBy(*keys, "_span").agg(F.max("ts").alias("ts"), F.max_by("v", "ts").alias("v"))
    following = F.lead("_span").over(Window.partitionBy(*keys).orderBy("_span"))
    handed = ends.select(*keys, following.alias("_span"), "ts", "v", F.lit(True).alias("_handed")).where("_span is not null")
    w = Window.partitionBy(*keys, "_span").orderBy("ts")
    both = rows.withColumn("_handed", F.lit(False)).unionByName(handed)
    return both.select(*keys, "ts", "v", F.lag("ts").over(w).alias("prev"), F.lag("v").over(w).alias("old"), "_handed").where("not _handed").drop("_handed")


def amounts(readings: DataFrame, source: DataSource, keys: tuple[str, ...] = ("series",), start: int | None = None, order: str | None = None) -> DataFrame:
    """keys, ts, prev, i (seconds), a (amount or null), r (rate or null) for each accepted reading.

    readings: keys, ts (whole seconds), v (number or text). Without start a series' first reading
    only opens it. With order (a column of arrival) readings not later than all before are dropped;
    otherwise of readings in one second the first counts.
    """
    if order:
        arrived = Window.partitionBy(*keys).orderBy(order)
        rows = readings.withColumn("_max", F.max("ts").over(arrived.rowsBetween(Window.unboundedPreceding, -1))).where("_max is null or ts > _max")
    else:
        rows = readings.groupBy(*keys, "ts").agg(F.min_by("v", "seq").alias("v")) if "seq" in readings.columns else readings.dropDuplicates([*keys, "ts"])
    rows = _with_last(rows, keys)
    if start is not None:
        rows = rows.withColumn("prev", F.coalesce("prev", F.lit(start)))
    rows = rows.where("prev is not null and ts > prev").withColumn("i", F.col("ts") - F.col("prev"))
    seconds = F.col("i").cast("double")
    amount, rate = _amount(source.kind, F.col("v"), F.col("old"), seconds)
    known = F.col("i") <= source.heartbeat
    if source.low is not None:
        known &= rate >= source.low
    if source.high is not None:
        known &= rate <= source.high
    a = F.when(known & ~F.isnan(amount), amount)
    return rows.select(*keys, "ts", "prev", "i", a.alias("a"), (a / seconds).alias("r"))


def pdps(readings: DataFrame, source: DataSource, step: int, keys: tuple[str, ...] = ("series",), start: int | None = None, order: str | None = None, horizon: int | None = None, runs: bool = False) -> DataFrame:
    """keys, ts (end of the step), v for each completed step; horizon: keep only so many steps
    before a series' last one, so that a long gap opens no more rows than archives keep; runs: also
    run, how many steps the reading closed that closed this one."""
    out = completed(amounts(readings, source, keys, start, order), source.heartbeat, step, keys, horizon)
    return out if runs else out.drop("run")


#: What is told of the reading that closes a step.
CLOSING = {"n": "bigint", "lead": "bigint", "span": "bigint", "i": "bigint", "r": "double"}


def completed(rows: DataFrame, heartbeat: int, step: int, keys: tuple[str, ...] = ("series",), horizon: int | None = None) -> DataFrame:
    """keys, ts, v, run: the PDPs of accepted readings as amounts() gives them."""
    s = F.lit(step)
    at, was = F.floor(F.col("ts") / s), F.floor(F.col("prev") / s)
    rows = rows.withColumn("n", at - was).withColumn("b0", was).withColumn("b1", at)
    tail = F.col("ts") - F.col("b1") * s
    # what a reading leaves in the step it ends in; what closes the step it began in
    inside = F.struct(
        F.col("b1").alias("b"),
        F.when(F.col("n") == 0, F.col("a")).otherwise(F.col("r") * tail).alias("k"),
        F.when(F.col("a").isNull(), F.when(F.col("n") == 0, F.col("i")).otherwise(tail)).alias("u"),
        *[F.lit(None).cast(t).alias(x) for x, t in CLOSING.items()],
    )
    span = F.col("b1") * s - F.col("prev")
    closing = F.struct(
        F.col("b0").alias("b"), F.lit(None).cast("double").alias("k"), F.lit(None).cast("bigint").alias("u"),
        F.col("n"), (span % s).alias("lead"), span.alias("span"), F.col("i"), F.col("r"),
    )
    parts = rows.select(*keys, F.inline(F.when(F.col("n") > 0, F.array(inside, closing)).otherwise(F.array(inside))))
    opened = rows.groupBy(*keys).agg(F.min("prev").alias("first"))
    # one reading closes a step; numbers of their own are hashed, a struct would have all parts sorted
    sums = parts.groupBy(*keys, "b").agg(F.sum("k").alias("k"), F.sum("u").alias("u"), *[F.max(x).alias(x) for x in CLOSING]).where("n is not null")
    # a database opened inside a step lacks the seconds before
    sums = sums.join(opened, list(keys)).withColumn("u", F.coalesce("u", F.lit(0)) + F.when(F.floor(F.col("first") / s) == F.col("b"), F.col("first") % s).otherwise(0))
    n, lead, w, i, r = (F.col(x) for x in CLOSING)
    one, split = n == 1, (n > 1) & (lead >= 1)
    part = F.when(split, lead).otherwise(w)
    length = F.when(one | split, s).otherwise(n * s)
    seconds = length - F.col("u") - F.when(r.isNull(), part).otherwise(0)
    total = F.when(r.isNull(), F.col("k")).otherwise(F.coalesce("k", F.lit(0.0)) + r * part)
    late = F.when(split, lead > heartbeat).otherwise(i > heartbeat)
    first = F.when((2 * F.col("u") <= s) & ~late & (seconds > 0), total / seconds)
    out = sums.select(*keys, F.col("b"), "n", first.alias("v"), r.alias("later"))
    kept = F.col("b")
    if horizon:
        out = out.join(out.groupBy(*keys).agg(F.max(F.col("b") + F.col("n") - 1).alias("_last")), list(keys))
        kept = F.greatest(F.col("b"), F.col("_last") - F.lit(horizon) + 1)
    out = out.withColumn("from", kept).where("from <= b + n - 1")
    out = out.withColumn("at", F.explode(F.sequence("from", F.col("b") + F.col("n") - 1)))
    return out.select(*keys, ((F.col("at") + 1) * s).alias("ts"), F.when(F.col("at") == F.col("b"), F.col("v")).otherwise(F.col("later")).alias("v"), (F.col("b") + F.col("n") - F.col("from")).cast("int").alias("run"))


def computed(pdp: DataFrame, name: str, cdef: str, keys: tuple[str, ...] = ("series",), source: str = "ds") -> DataFrame:
    """A COMPUTE data source: an expression over the PDPs of one step. pdp: keys, ds, ts, v."""
    from ..functions.rpn import Expression

    e = Expression.parse(cdef)
    wide = pdp.groupBy(*keys, "ts").pivot(source, sorted(e.variables)).agg(F.first("v"))
    return wide.select(*keys, F.lit(name).alias(source), "ts", e.column({x: F.col(x) for x in e.variables}).alias("v"))


def native_pdps(readings: DataFrame, step: int, heartbeat: int, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """The small store's rule: a gap over the heartbeat voids the whole step it closes, and a step
    is known if at least half its seconds are."""
    source = DataSource("v", "GAUGE", heartbeat)
    rows = amounts(readings, source, keys)
    s = F.lit(step)
    piece = rows.withColumn("b", F.explode(F.sequence(F.floor(F.col("prev") / s), F.floor((F.col("ts") - 1) / s))))
    over = F.least(F.col("ts"), (F.col("b") + 1) * s) - F.greatest(F.col("prev"), F.col("b") * s)
    piece = piece.withColumn("over", over)
    last = piece.groupBy(*keys).agg(F.max("ts").alias("_end"))
    sums = piece.groupBy(*keys, "b").agg(F.sum(F.col("r") * F.col("over")).alias("k"), F.sum(F.when(F.col("r").isNotNull(), F.col("over"))).alias("n"), F.max(F.col("i") > heartbeat).alias("gap"))
    value = F.when(~F.col("gap") & (2 * F.coalesce("n", F.lit(0)) >= s), F.col("k") / F.col("n"))
    return sums.join(last, list(keys)).where((F.col("b") + 1) * s <= F.col("_end")).select(*keys, ((F.col("b") + 1) * s).alias("ts"), value.alias("v"))
