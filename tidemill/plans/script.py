"""Scripts: DEF, CDEF, VDEF, SHIFT, XPORT, PRINT and the drawing elements, planned as DataFrames.

Elements run in order. Every named series is a plan of its own with a step and a window; columns of
different steps meet on a grid of their greatest common divisor by an equi-join on the end of the
interval that holds the grid's time, never by a range join.

A script with ``keys`` runs over every database of a fleet at once: points and series carry the key
columns, every join, window and aggregate is by key, and one plan computes all of them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, times
from ..functions.recurrence import recurrence
from ..functions.rpn import PAST, Expression, Grid, past
from ..operators import consolidate, fetch
from ..operators import vdef as aggregates
from ..schema import Database


@dataclass
class Series:
    """Rows (keys, ts, v) of (start, end], one every step."""

    rows: DataFrame
    start: int
    end: int
    step: int


@dataclass
class Source:
    """A database that DEF may name, or many of one definition: points (keys, series, rra, ts, v),
    where series is the data source."""

    db: Database
    points: DataFrame

    def names(self) -> list[str]:
        return [s.name for s in self.db.sources]


def fields(text: str) -> list[str]:
    """Parts of an element; ``\\:`` is a colon."""
    return [x.replace("\0", ":") for x in text.replace("\\:", "\0").split(":")]


def at_end(ts: Column, start: int, step: int) -> Column:
    """The end of the interval of a series that holds the time ts."""
    return F.ceil((ts - start) / F.lit(step)) * step + start


@dataclass
class Script:
    start: int
    end: int
    sources: dict[str, Source]
    step: int = 1
    now: int = 0
    zone: str = "UTC"
    series: dict[str, Series] = field(default_factory=dict)
    scalars: dict[str, DataFrame] = field(default_factory=dict)
    exports: list[tuple[str, str]] = field(default_factory=list)
    drawn: list[tuple[str, str, bool]] = field(default_factory=list)
    prints: list[tuple[DataFrame, ...]] = field(default_factory=list)
    fetched: dict[tuple, Series] = field(default_factory=dict)
    keys: tuple[str, ...] = ()
    rules: list[tuple[str, float | DataFrame]] = field(default_factory=list)

    @classmethod
    def between(cls, start: str, end: str, sources: dict[str, Source], now: int, zone: str = "UTC", step: int = 1, rows: int | None = None) -> Script:
        """A script over a window of at-style times; rows: so many at most, by a coarser step."""
        first, last = times.window(start, end, now, zone)
        if first < times.EPOCH_FROM:
            raise ValueError(f"the first entry to fetch should be after 1980 ({first})")
        return cls(first, last, sources, max(step, (last - first) // rows) if rows else step, now, zone)

    def run(self, *elements: str) -> Script:
        for e in elements:
            kind, _, rest = e.partition(":")
            kind = re.sub(r"\d+(\.\d+)?$", "", kind)
            if kind in ("DEF", "CDEF", "VDEF"):
                name, _, body = rest.partition("=")
                getattr(self, kind.lower())(name, body)
            elif kind in ("SHIFT", "XPORT", "PRINT", "GPRINT", "LINE", "AREA", "STACK", "TICK"):
                getattr(self, {"GPRINT": "print"}.get(kind, kind.lower()))(*fields(rest))
            elif kind in ("HRULE", "VRULE"):
                self.rule(kind, rest.split("#")[0])
            elif kind not in ("COMMENT", "TEXTALIGN"):
                raise ValueError(f"unknown element {kind!r}")
        return self

    # sources of series

    def define(self, name: str, rows: DataFrame, start: int, end: int, step: int) -> Script:
        """A series from any DataFrame (keys, ts, v)."""
        self.series[name] = Series(rows.select(*self.keys, "ts", "v"), start, end, step)
        return self

    def def_(self, name: str, body: str) -> None:
        where, ds, cf, *options = fields(body)
        how = dict(o.split("=", 1) for o in options)
        start, end, step = self.start, self.end, int(how.get("step", self.step))
        if "start" in how or "end" in how:
            start, end = times.window(how.get("start", str(start)), how.get("end", str(end)), self.now, self.zone)
        key = (where, ds, cf, start, end, step, how.get("reduce"))
        if key not in self.fetched:
            source = self.sources[where]
            if ds not in source.names():
                raise ValueError(f"No DS called {ds!r} in {where!r}")
            by = self.keys or ("series",)
            rows, first, last, slot = fetch.fetch(source.points.where(F.col("series") == ds), source.db, cf, start, end, step, keys=by, series=None if self.keys else [ds])
            if "reduce" in how or step > slot:
                rows, slot = consolidate.reduced(rows, slot, step, how.get("reduce", cf), first, last, keys=by)
                first, last = first - first % slot, last - last % slot + (slot if last % slot else 0)
            self.fetched[key] = Series(rows.select(*self.keys, "ts", "v"), first, last, slot)
        self.series[name] = self.fetched[key]

    # computed series

    def aligned(self, names: list[str], start: int, end: int, step: int) -> DataFrame:
        """keys, ts and a column for each name, on the grid (start, end]; PREV(name) is the sample
        before that of the name, at the name's own step. A key has rows if one of the series does."""
        used = [self.series[n] for n in names if n in self.series]
        if self.keys:
            told = reduce(DataFrame.unionByName, [x.rows.select(*self.keys) for x in used]).distinct()
            out = told.withColumn("ts", F.explode(F.sequence(F.lit(start + step), F.lit(end), F.lit(step)))) if end > start else told.limit(0).withColumn("ts", F.lit(0))
        else:
            out = fetch.grid(next(iter(self.series.values())).rows.sparkSession, start, end, step)
        for n in names:
            if n in self.scalars:
                scalar = self.scalars[n].select(*self.keys, F.col("value").alias(n))
                out = out.join(scalar, list(self.keys), "left") if self.keys else out.crossJoin(F.broadcast(scalar))  # one row
                continue
            s = self.series[n.removeprefix("PREV(").removesuffix(")")]
            v = F.lag("v").over(self.by_key().orderBy("ts")) if n.startswith("PREV(") else F.col("v")
            rows = s.rows.select(*self.keys, F.col("ts").alias("_end"), v.alias(n))
            inside = (F.col("ts") > s.start) & (F.col("ts") <= s.end)
            out = out.withColumn("_end", F.when(inside, at_end(F.col("ts"), s.start, s.step))).join(rows, [*self.keys, "_end"], "left").drop("_end")
        return out

    def by_key(self):
        return Window.partitionBy(*(self.keys or (F.lit(0),)))

    def history(self, e: Expression, step: int) -> dict[int, tuple[Series, Column]]:
        """Of each operator over the past of a variable that is coarser than the grid, by its place
        in the expression: the series, with a row before its first one, and what the operator reads
        there, made of the variable's own samples."""
        out = {}
        for at, (kind, op) in enumerate(e.tokens):
            if kind != "operator" or op not in PAST:
                continue
            name = e.tokens[at - (2 if op.startswith("TREND") else 1)][1]
            s = self.series.get(name)
            if s is None or s.step == step:
                continue
            keys = s.rows.select(*self.keys).distinct() if self.keys else s.rows.sparkSession.range(1).select()
            rows = s.rows.unionByName(keys.select(*self.keys, F.lit(s.start).alias("ts"), F.lit(None).cast("double").alias("v")))
            out[at] = Series(rows, s.start, s.end, s.step), past(e.tokens[: at + 1], s.step, self.by_key().orderBy("ts"))
        return out

    def cdef(self, name: str, body: str) -> None:
        e = Expression.parse(body)
        names = sorted(e.variables - {name})
        used = [self.series[n] for n in names if n in self.series]
        if not used:
            raise ValueError("a CDEF names at least one DEF or CDEF")
        step = math.gcd(*(s.step for s in used))
        start, end = max(s.start for s in used), min(s.end for s in used)
        if start > end:
            raise ValueError("the series of a CDEF have no time in common")
        grid = Grid(step=step, keys=self.keys or ("series",), now=self.now, zone=self.zone)
        variables = {n: F.col(n) for n in names}
        for n in sorted({x for kind, x in e.tokens if kind == "previous"}):
            if n in self.scalars:
                variables[f"PREV({n})"] = F.col(n)
            elif n in self.series and self.series[n].step != step:
                variables[f"PREV({n})"] = F.when(F.row_number().over(grid.order()) > 1, F.col(f"PREV({n})"))
        before = [n for n in variables if n.startswith("PREV(") and n[5:-1] in self.series]
        rows = self.aligned([*names, *before], start, end, step)
        for at, (s, read) in self.history(e, step).items():
            # the newest sample that is over by the row's time
            own = s.rows.select(*self.keys, F.col("ts").alias("_end"), read.alias(f"_past{at}"))
            rows = rows.withColumn("_end", F.col("ts") - F.pmod(F.col("ts"), F.lit(s.step))).join(own, [*self.keys, "_end"], "left").drop("_end")
            grid.past[at] = F.col(f"_past{at}")
            grid.steps |= {n: self.series[n].step for n in names if n in self.series}
        if not self.keys:
            rows = rows.withColumn("series", F.lit(name))
        if e.recurrent and e.accumulates() is None:
            rows = recurrence(rows, e, variables, grid).select(*self.keys, "ts", "v")
        else:
            rows = rows.select(*self.keys, "ts", e.column(variables, grid).alias("v"))
        self.series[name] = Series(rows, start, end, step)

    def vdef(self, name: str, body: str) -> None:
        variable, *rest = body.split(",")
        function, parameter = rest[-1], float(rest[0]) if len(rest) > 1 else None
        s = self.series[variable]
        rows = s.rows if self.keys else s.rows.withColumn("series", F.lit(variable))
        self.scalars[name] = aggregates.vdef(rows, function, s.step, parameter, self.keys or ("series",)).select(*self.keys, "value", "time")

    def shift(self, name: str, offset: str) -> None:
        """By whole steps; a later SHIFT replaces an earlier one."""
        s = self.series[name]
        if offset in self.scalars:
            if self.keys:
                raise ValueError("a SHIFT by a VDEF differs from key to key")
            seconds = int(self.scalars[offset].first()["value"])  # one number, needed to plan the window
        else:
            seconds = int(offset)
        before = getattr(s, "shifted", 0)
        whole = int(seconds / s.step) * s.step
        move = whole - before
        self.series[name] = Series(s.rows.withColumn("ts", F.col("ts") + move), s.start + move, s.end + move, s.step)
        self.series[name].shifted = whole

    # outputs

    def xport(self, name: str, legend: str = "") -> None:
        if name in self.scalars:
            raise ValueError("XPORT takes a DEF or CDEF")
        self.exports.append((name, legend or name))

    def export(self, drawn: bool = False) -> DataFrame:
        """ts and the exported columns, on the grid of their common step over the image window."""
        columns = [(n, n) for n, _, _ in self.drawn] if drawn else self.exports
        step = math.gcd(*(self.series[n].step for n, _ in columns if n in self.series))
        start, end = self.start - self.start % step, -(-self.end // step) * step
        rows = self.aligned(list(dict.fromkeys(n for n, _ in columns)), start, end, step)
        return rows.select(*self.keys, "ts", *[F.col(n).alias(legend) for n, legend in columns])

    def line(self, body: str, *rest: str) -> None:
        self.drawn.append((body.split("#")[0], "LINE", "STACK" in rest))

    def area(self, body: str, *rest: str) -> None:
        self.drawn.append((body.split("#")[0], "AREA", "STACK" in rest))

    def stack(self, body: str, *rest: str) -> None:
        self.drawn.append((body.split("#")[0], "STACK", True))

    def tick(self, body: str, *rest: str) -> None:
        self.drawn.append((body.split("#")[0], "TICK", False))

    def stacked(self) -> DataFrame:
        """The drawn columns as heights: a stacked one lies on the one before, unknown adds nothing."""
        rows, out, below = self.export(drawn=True), [*map(F.col, self.keys), F.col("ts")], None
        for n, _, on in self.drawn:
            c = F.col(n)
            height = F.when(c.isNotNull(), c + F.coalesce(below, F.lit(0.0))) if on and below is not None else c
            below = F.coalesce(height, below) if on and below is not None else height
            out.append(height.alias(n))
        return rows.select(*out)

    def rule(self, kind: str, place: str) -> None:
        """A line across at a value (HRULE) or a time (VRULE): a number, or what a VDEF gives."""
        if place in self.scalars:
            s = self.scalars[place]
            self.rules.append((kind, s.select(*self.keys, F.col("value" if kind == "HRULE" else "time").cast("double").alias("at"))))
        else:
            self.rules.append((kind, float(place)))

    def ruled(self) -> DataFrame:
        """place, kind, at (and keys where a VDEF has them) of all rules in order."""
        spark = next(iter(self.series.values())).rows.sparkSession
        parts = []
        for i, (kind, at) in enumerate(self.rules):
            rows = at if isinstance(at, DataFrame) else spark.createDataFrame([(at,)], "at double")
            parts.append(rows.select(F.lit(i).alias("place"), F.lit(kind).alias("kind"), *[c for c in rows.columns]))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def ticks(self, name: str) -> DataFrame:
        return self.series[name].rows.where((F.col("v") != 0) & (F.abs("v") < float("inf")))

    def print(self, name: str, *rest: str) -> None:
        if name in self.scalars:
            self.prints.append((self.scalars[name], *rest))
            return
        cf, template = rest
        cf = {"FAILURES": "MAX"}.get(cf, cf if cf in ("AVERAGE", "MIN", "MAX", "LAST") else "AVERAGE")
        s = self.series[name]
        v = aggregates.finite(F.col("v"))
        value = F.max_by("v", F.when(v.isNotNull(), F.col("ts"))) if cf == "LAST" else {"AVERAGE": F.avg, "MIN": F.min, "MAX": F.max}[cf](v)
        self.prints.append((s.rows.groupBy(*self.keys).agg(value.alias("value")).withColumn("time", F.lit(None).cast("long")), template))

    def printed(self, base: int = 1000) -> list[str]:
        """The texts of all PRINT elements in order: each is one value, its format and perhaps strftime,
        valstrftime or valstrfduration."""
        if self.keys:
            raise ValueError("texts are of one database; prints holds the values of each key")
        out, kept = [], None
        for rows, template, *how in self.prints:
            got = rows.first()
            value = got["value"] if got else None
            if not how:
                text, kept = formats.number(template, value, base, kept)
            elif how == ["strftime"]:
                text = formats.time(template, got["time"] if got else None, self.zone)
            elif how == ["valstrftime"]:
                text = formats.time_of_value(template, value)
            elif how == ["valstrfduration"]:
                text = formats.duration(template, value)
            else:
                raise ValueError(f'Unused Arguments "{":".join(how)}"')
            out.append(text)
        return out


# "def" is a word of the language
setattr(Script, "def", Script.def_)

