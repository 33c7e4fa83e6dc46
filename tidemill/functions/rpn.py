"""The stack language of row expressions, compiled to Spark columns.

The stack runs once, when the plan is made, and holds expressions; what a row costs is the compiled
column alone. Unknown is null: every operation that can give NaN is wrapped, and no operation that
raises in ANSI mode is used bare. Operators that count stack slots need literal counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")
#: Factors of DEG2RAD and RAD2DEG.
TO_RADIANS, TO_DEGREES = 0.0174532952, 57.29577951

#: The operators.
OPERATORS = (
    "+", "-", "*", "/", "%", "ADDNAN", "POW", "ATAN2", "SIN", "COS", "LOG", "EXP", "ATAN", "SQRT", "FLOOR", "CEIL", "ROUND", "ABS", "DEG2RAD", "RAD2DEG",
    "LT", "LE", "GT", "GE", "EQ", "NE", "UN", "ISINF", "IF", "MIN", "MAX", "MINNAN", "MAXNAN", "LIMIT", "UNKN", "INF", "NEGINF", "PREV", "COUNT",
    "NOW", "TIME", "LTIME", "STEPWIDTH", "NEWDAY", "NEWWEEK", "NEWMONTH", "NEWYEAR", "DUP", "POP", "EXC", "DEPTH", "COPY", "INDEX", "ROLL",
    "SORT", "REV", "AVG", "SMIN", "SMAX", "MEDIAN", "STDEV", "PERCENT", "TREND", "TRENDNAN", "PREDICT", "PREDICTSIGMA", "PREDICTPERC",
)

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z")
_NAME = re.compile(r"[A-Za-z0-9_-]+\Z")


def known(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def number(x: float) -> Column:
    return F.lit(None).cast("double") if math.isnan(x) else F.lit(float(x))


def flag(c: Column) -> Column:
    return c.cast("double")


def divide(x: Column, y: Column) -> Column:
    safe = F.when(y != 0, y).otherwise(F.lit(1.0))
    at_zero = F.when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF)) * F.when(F.signum(y) == 0, 1.0)
    return known(F.when(y == 0, at_zero).otherwise(x / safe))


def modulo(x: Column, y: Column) -> Column:
    return known(F.when(y != 0, x % F.when(y != 0, y).otherwise(F.lit(1.0))))


def power(x: Column, y: Column) -> Column:
    return F.when(y == 0, F.lit(1.0)).when(x == 1, F.lit(1.0)).otherwise(known(F.pow(x, y)))


def whole(f: Callable[[Column], Column], x: Column) -> Column:
    """floor, ceil: doubles beyond 2^53 are whole already."""
    return F.when(F.abs(x) < F.lit(float(1 << 53)), f(F.when(F.abs(x) < F.lit(float(1 << 53)), x)).cast("double")).otherwise(x)


def rounded(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float(1 << 52)), F.signum(x) * F.floor(F.when(F.abs(x) < F.lit(float(1 << 52)), F.abs(x)) + 0.5).cast("double")).otherwise(x)


def both(x: Column, y: Column, c: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), c)


UNARY: dict[str, Callable[[Column], Column]] = {
    "SIN": lambda x: known(F.sin(x)),
    "COS": lambda x: known(F.cos(x)),
    "LOG": lambda x: F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x)),
    "EXP": lambda x: F.exp(x),
    "ATAN": lambda x: F.atan(x),
    "SQRT": lambda x: F.when(x >= 0, F.sqrt(x)),
    "FLOOR": lambda x: whole(F.floor, x),
    "CEIL": lambda x: whole(F.ceil, x),
    "ROUND": rounded,
    "ABS": F.abs,
    "DEG2RAD": lambda x: x * F.lit(TO_RADIANS),
    "RAD2DEG": lambda x: x * F.lit(TO_DEGREES),
    "UN": lambda x: flag(x.isNull()),
    "ISINF": lambda x: flag(F.coalesce(F.abs(x) == F.lit(INF), F.lit(False))),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda x, y: known(x + y),
    "-": lambda x, y: known(x - y),
    "*": lambda x, y: known(x * y),
    "/": divide,
    "%": modulo,
    "ADDNAN": lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(known(x + y)),
    "POW": power,
    "ATAN2": lambda x, y: F.atan2(x, y),
    "LT": lambda x, y: flag(x < y),
    "LE": lambda x, y: flag(x <= y),
    "GT": lambda x, y: flag(x > y),
    "GE": lambda x, y: flag(x >= y),
    "EQ": lambda x, y: flag(x == y),
    "NE": lambda x, y: flag(x != y),
    "MIN": lambda x, y: both(x, y, F.least(x, y)),
    "MAX": lambda x, y: both(x, y, F.greatest(x, y)),
    "MINNAN": lambda x, y: F.least(x, y),
    "MAXNAN": lambda x, y: F.greatest(x, y),
}


@dataclass
class Grid:
    """What a row knows besides its variables. keys: of the series; ts: end of the row."""

    step: int = 1
    keys: tuple[str, ...] = ("series",)
    ts: str = "ts"
    now: int = 0
    zone: str = "UTC"
    week_starts: int = 0  # 0 is Sunday
    steps: dict[str, int] = field(default_factory=dict)  # of variables coarser than the grid
    past: dict[int, Column] = field(default_factory=dict)  # what PAST operators read, by their place

    def order(self):
        return Window.partitionBy(*self.keys).orderBy(self.ts)


#: Operators over the samples of one variable before the row.
PAST = ("TREND", "TRENDNAN", "PREDICT", "PREDICTSIGMA", "PREDICTPERC")


def _arguments(tokens: list[tuple[str, object]]) -> tuple[float, list[float]]:
    """Window and shifts of the PREDICT operator that ends tokens."""
    op = tokens[-1][1]
    end = len(tokens) - (3 if op == "PREDICTPERC" else 2)  # the variable and perhaps a percentile follow
    numbers = []
    for kind, x in reversed(tokens[:end]):
        if kind != "number":
            break
        numbers.append(x)
    if len(numbers) < 2:
        raise ValueError(f"the arguments of {op} must be numbers")
    window, k, *rest = numbers
    k = int(k)
    if len(rest) < (k if k >= 0 else 1):
        raise ValueError(f"the shifts of {op} must be numbers")
    shifts = [i * rest[0] for i in range(-k)] if k < 0 else rest[:k][::-1]
    if any(s < 0 for s in shifts):
        raise ValueError(f"negative shift of {op}")
    return window, shifts


def past(tokens: list[tuple[str, object]], step: int, w) -> Column:
    """What the operator that ends tokens reads of a variable of its own step, at the newest of its
    samples: the mean of a TREND, or an array of (o, v), the samples of a PREDICT by their offsets.

    w: a window over the variable's samples after one more row that stands before the first.
    Samples before the first count as 0, those after the last are unknown."""
    op, k, v = tokens[-1][1], F.row_number().over(w) - 1, F.col("v")
    if op in ("TREND", "TRENDNAN"):
        if tokens[-2][0] != "number":
            raise ValueError("the window of a trend must be a number")
        n = max(1, math.ceil(tokens[-2][1] / step))
        frame = w.rowsBetween(-(n - 1), 0)
        missing = F.greatest(n - k, F.lit(0))
        counted = F.count(v).over(frame) + missing
        mean = F.coalesce(F.sum(v).over(frame), F.lit(0.0)) / F.greatest(counted, F.lit(1))
        return F.when(counted == n if op == "TREND" else counted > 0, mean)
    window, shifts = _arguments(tokens)
    offsets = [math.ceil(s / step) + j for s in shifts for j in range(math.ceil(window / step) + 1)]
    sample = lambda o: F.when(k >= o, F.lead(v, 1 - o).over(w) if o < 1 else F.lag(v, o - 1).over(w)).otherwise(0.0)
    return F.array(*[F.struct(F.lit(o).alias("o"), sample(o).alias("v")) for o in offsets])


class Expression:
    """A parsed expression: tokens are numbers, operators, PREV(name) and variables."""

    def __init__(self, tokens: list[tuple[str, object]]) -> None:
        self.tokens = tokens
        self.variables = {x for kind, x in tokens if kind in ("variable", "previous")}
        self.recurrent = ("operator", "PREV") in tokens

    @classmethod
    def parse(cls, text: str) -> Expression:
        words = text.removesuffix(",").split(",")
        out: list[tuple[str, object]] = []
        for w in words:
            if _NUMBER.match(w):
                out.append(("number", float(w)))
            elif w in OPERATORS:
                out.append(("operator", w))
            elif m := re.fullmatch(r"PREV\(([A-Za-z0-9_-]+)\)", w):
                out.append(("previous", m[1]))
            elif _NAME.match(w):
                out.append(("variable", w))
            else:
                raise ValueError(f"not a word of an expression: {w!r}")
        return cls(out)

    def accumulates(self) -> Expression | None:
        """x of ``x,PREV,ADDNAN`` or ``PREV,x,ADDNAN``, the running sum; else None."""
        for at in (0, len(self.tokens) - 2):
            if self.tokens[at : at + 1] == [("operator", "PREV")] and self.tokens[-1:] == [("operator", "ADDNAN")]:
                rest = Expression([t for i, t in enumerate(self.tokens[:-1]) if i != at])
                if not rest.recurrent:
                    return rest
        return None

    def column(self, variables: dict[str, Column], grid: Grid | None = None) -> Column:
        """The expression as a column over rows that hold all variables; PREV(x) among them stands
        for the sample before that of x, where the row before does not have it."""
        if self.recurrent:
            rest = self.accumulates()
            if rest is None:
                raise ValueError("this recurrence has no column form; see functions.recurrence")
            return F.sum(rest.column(variables, grid)).over(grid.order().rowsBetween(Window.unboundedPreceding, 0))
        return Compiler(variables, grid or Grid()).run(self.tokens)


class Compiler:
    def __init__(self, variables: dict[str, Column], grid: Grid) -> None:
        self.variables, self.grid = variables, grid
        self.stack: list[Column] = []
        self.literal: list[float | None] = []  # of each slot, its value if it is a number
        self.above: list[Column] = []  # what popped slots still hold, lowest first

    def push(self, c: Column, literal: float | None = None) -> None:
        self.stack.append(c)
        self.literal.append(literal)

    def pop(self, n: int = 1) -> list[Column]:
        if len(self.stack) < n:
            raise ValueError("RPN stack underflow")
        out = self.stack[len(self.stack) - n :]
        del self.stack[len(self.stack) - n :], self.literal[len(self.literal) - n :]
        return out

    def count(self) -> int:
        if not self.stack:
            raise ValueError("RPN stack underflow")
        n = self.literal[-1]
        if n is None:
            raise ValueError("a count must be a number in the expression")
        self.above = self.pop()
        return int(n)

    def run(self, tokens: list[tuple[str, object]]) -> Column:
        self.tokens = tokens
        for self.at, (kind, x) in enumerate(tokens):
            if kind == "number":
                self.push(number(x), x)
            elif kind == "variable":
                self.push(self.variables[x] if x in self.variables else number(math.nan))
            elif kind == "previous":
                own = self.variables.get(f"PREV({x})")
                self.push(F.lag(self.variables[x]).over(self.grid.order()) if own is None else own)
            else:
                self.apply(x)
        if len(self.stack) != 1:
            raise ValueError("RPN final stack size != 1")
        return self.stack[0]

    def apply(self, op: str) -> None:
        g = self.grid
        if op in UNARY:
            self.push(UNARY[op](*self.pop()))
        elif op in BINARY:
            self.push(BINARY[op](*self.pop(2)))
        elif op == "IF":
            c, a, b = self.pop(3)
            self.push(F.when(c != 0, a).otherwise(b))
        elif op == "LIMIT":
            v, lo, hi = self.pop(3)
            self.push(F.when((v >= lo) & (v <= hi), v))
        elif op in ("UNKN", "INF", "NEGINF"):
            x = {"UNKN": math.nan, "INF": INF, "NEGINF": -INF}[op]
            self.push(number(x), x)
        elif op == "COUNT":
            self.push(F.row_number().over(g.order()).cast("double"))
        elif op == "NOW":
            self.push(number(g.now), g.now)
        elif op == "STEPWIDTH":
            self.push(number(g.step), g.step)
        elif op == "TIME":
            self.push(F.col(g.ts).cast("double"))
        elif op == "LTIME":
            self.push((F.col(g.ts) + self.offset(F.col(g.ts))).cast("double"))
        elif op.startswith("NEW"):
            self.push(flag(self.period(op[3:], F.col(g.ts)) != self.period(op[3:], F.col(g.ts) - g.step)))
        elif op == "DUP":
            n = self.literal[-1] if self.literal else None
            (c,) = self.pop()
            self.push(c, n), self.push(c, n)
        elif op == "POP":
            self.pop()
        elif op == "EXC":
            a, b = self.literal[-2:]
            x, y = self.pop(2)
            self.push(y, b), self.push(x, a)
        elif op == "DEPTH":
            n = len(self.stack)
            self.push(number(n), n)
        elif op == "COPY":
            n = self.count()
            self.need(n)
            for c, x in list(zip(self.stack, self.literal))[len(self.stack) - n :]:
                self.push(c, x)
        elif op == "INDEX":
            n = self.count()
            if n == 0:
                self.push(number(0), 0)
            else:
                self.need(n)
                self.push(self.stack[-n], self.literal[-n])
        elif op == "ROLL":
            self.roll()
        elif op == "REV":
            n = self.count()
            self.need(n)
            values = self.pop(n)
            for c in reversed(values):
                self.push(c)
        elif op in ("SORT", "AVG", "SMIN", "SMAX", "MEDIAN", "STDEV"):
            n = self.count()
            self.need(n)
            self.of_set(op, self.pop(n))
        elif op == "PERCENT":
            self.percentile()
        elif op in ("TREND", "TRENDNAN"):
            self.trend(op == "TRENDNAN")
        else:
            self.predict(op)

    def need(self, n: int) -> None:
        if n < 0 or n > len(self.stack):
            raise ValueError("RPN stack underflow")

    def local(self, seconds: Column) -> Column:
        return F.from_utc_timestamp(F.timestamp_seconds(seconds), self.grid.zone)

    def offset(self, seconds: Column) -> Column:
        """Of the zone from UTC. Days are told apart by their number in the year, so that on 31
        December a zone that is behind a new year in UTC comes out two days ahead."""
        here, utc = self.local(seconds), F.from_utc_timestamp(F.timestamp_seconds(seconds), "UTC")
        of_day = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
        later = (F.dayofyear(here) > F.dayofyear(utc)) | (F.year(here) > F.year(utc))
        earlier = (F.dayofyear(here) < F.dayofyear(utc)) | (F.year(here) < F.year(utc))
        return of_day(here) - of_day(utc) + F.when(later, 86400).when(earlier, -86400).otherwise(0)

    def period(self, unit: str, seconds: Column) -> Column:
        t = self.local(seconds)
        if unit == "WEEK":
            return F.date_trunc("week", t - F.make_interval(days=F.lit(self.grid.week_starts - 1)))
        return F.date_trunc(unit.lower(), t)

    def roll(self) -> None:
        """The top value and the slots above it, which still hold the count and the shift, make a
        circle. Turned by the shift and read from its end it replaces the top values. What more
        slots above would hold is not defined; here it is 0."""
        slots = self.stack[-2:]
        shift, n = self.count(), self.count()
        self.need(n)
        if n > 1:
            circle = deque([self.stack[-1], *slots, *[number(0)] * (n - 3)][:n])
            circle.reverse()
            circle.rotate(shift)
            self.pop(n)
            for c in circle:
                self.push(c)

    def of_set(self, op: str, values: list[Column]) -> None:
        rows = F.array(*values) if values else F.array().cast("array<double>")
        real = F.filter(rows, lambda x: x.isNotNull())
        n = F.size(real)
        total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values], F.lit(0.0))
        if op == "SORT":
            ordered = F.sort_array(rows)
            for k in range(len(values)):
                self.push(F.get(ordered, F.lit(k)))
        elif op == "AVG":
            self.push(known(F.when(n > 0, total / F.greatest(n, F.lit(1)))))
        elif op in ("SMIN", "SMAX"):
            self.push((F.array_min if op == "SMIN" else F.array_max)(real))
        elif op == "MEDIAN":
            s = F.sort_array(real)
            low, high = F.get(s, F.floor((n - 1) / F.lit(2)).cast("int")), F.get(s, F.floor(n / F.lit(2)).cast("int"))
            self.push(F.when(n > 0, known((low + high) / 2)))
        else:
            mean = total / F.greatest(n, F.lit(1))
            squares = reduce(lambda a, b: a + b, [F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in values], F.lit(0.0))
            self.push(F.when((n > 1) & ~F.exists(real, lambda x: F.abs(x) == INF), F.sqrt(squares / F.greatest(n - 1, F.lit(1)))))

    def percentile(self) -> None:
        n = self.count()
        p = self.literal[-1]
        self.pop()
        if p is None or not 0 <= p <= 100:
            raise ValueError("a percentile is a number from 0 to 100")
        self.need(n)
        values = self.pop(n)
        rank = math.floor(p * n / 100 + 0.5)
        if rank == 0:
            if not self.stack:
                raise ValueError("RPN stack underflow")
            self.push(self.stack[-1])
        else:
            self.push(F.get(F.sort_array(F.array(*values)), F.lit(min(rank, n) - 1)))

    def trend(self, skip: bool) -> None:
        window = self.literal[-1]
        if window is None:
            raise ValueError("the window of a trend must be a number")
        x = self.pop(2)[0]
        w = self.grid.order()
        own = self.grid.past.get(self.at)
        if own is not None:
            self.push(F.when(F.row_number().over(w) >= math.ceil(window / self.own_step(2)), own))
            return
        n = max(1, math.ceil(window / self.grid.step))
        frame = w.rowsBetween(-(n - 1), 0)
        mean = F.avg(x).over(frame)
        if not skip:
            mean = F.when(F.count(x).over(frame) == n, mean)
        self.push(F.when(F.row_number().over(w) >= n, mean))

    def own_step(self, back: int) -> int:
        return self.grid.steps[self.tokens[self.at - back][1]]

    def predict(self, op: str) -> None:
        """Shifts and the window are literals; the samples are lags of x."""
        p = self.literal[-2] if op == "PREDICTPERC" else None
        if op == "PREDICTPERC" and (p is None or abs(p) > 100):
            raise ValueError("a percentile is a number from -100 to 100")
        window, shifts = _arguments(self.tokens[: self.at + 1])
        k = self.literal[-4 if op == "PREDICTPERC" else -3]
        (x,) = self.pop()
        self.pop((3 if op == "PREDICTPERC" else 2) + (int(k) if k >= 0 else 1))
        step, w = self.grid.step, self.grid.order()
        at = F.row_number().over(w) - 1
        own = self.grid.past.get(self.at)
        if own is not None:
            rows = F.transform(F.filter(own, lambda s: (s["o"] < at) & s["v"].isNotNull()), lambda s: s["v"])
        else:
            offsets = [math.ceil(s / step) + j for s in shifts for j in range(math.ceil(window / step) + 1)]
            # offset 0 is the sample after the row's own; only offsets below the row's index count
            sample = lambda o: F.when(F.lit(o) < at, F.lead(x, 1 - o).over(w) if o < 1 else F.lag(x, o - 1).over(w))
            rows = F.filter(F.array(*[sample(o) for o in offsets]), lambda v: v.isNotNull())
        n = F.size(rows)
        mean = F.aggregate(rows, F.lit(0.0), lambda a, v: a + v) / F.greatest(n, F.lit(1))
        if op == "PREDICT":
            self.push(F.when(n > 0, mean))
        elif op == "PREDICTSIGMA":
            squares = F.aggregate(rows, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
            self.push(F.when(n > 1, F.sqrt(squares / F.greatest(n - 1, F.lit(1)))))
        else:
            s = F.sort_array(rows)
            if p < 0:
                at = F.floor(F.lit(-p / 100) * (n - 1) + 0.5).cast("int")
                self.push(F.when(n > 0, F.get(s, at)))
            else:
                rank = F.lit(p / 100) * (n - 1)
                low = F.floor(rank).cast("int")
                a, b = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
                self.push(F.when(n > 0, a + (b - a) * (rank - low)))
