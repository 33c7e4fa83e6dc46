"""Expressions over their own previous value.

Only what touches PREV needs the row before. The stack runs once, when the plan is made, and leaves a
tree; its largest parts without PREV become columns as in ``rpn``, and what is left is a function of
those columns' values and the last result, called row by row in time order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rpn import BINARY, INF, TO_DEGREES, TO_RADIANS, UNARY, Expression, Grid

LEAVES = ("UNKN", "INF", "NEGINF", "COUNT", "NOW", "TIME", "LTIME", "STEPWIDTH", "NEWDAY", "NEWWEEK", "NEWMONTH", "NEWYEAR")
SETS = ("AVG", "SMIN", "SMAX", "MEDIAN", "STDEV")
nan = math.isnan


def _divide(x: float, y: float) -> float:
    return x / y if y else math.nan if x == 0 or nan(x) else math.copysign(INF, x)


def _round(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x) if abs(x) < 1 << 52 else x


def _compare(f: Callable[[float, float], bool]) -> Callable[[float, float], float]:
    return lambda x, y: math.nan if nan(x) or nan(y) else float(f(x, y))


#: The same meaning as the columns of the same names; NaN is unknown.
ONE: dict[str, Callable[[float], float]] = {
    "SIN": np.sin, "COS": np.cos, "LOG": np.log, "EXP": np.exp, "ATAN": np.arctan, "SQRT": np.sqrt, "FLOOR": np.floor, "CEIL": np.ceil,
    "ROUND": _round, "ABS": abs, "DEG2RAD": lambda x: x * TO_RADIANS, "RAD2DEG": lambda x: x * TO_DEGREES,
    "UN": lambda x: float(nan(x)), "ISINF": lambda x: float(abs(x) == INF),
}
TWO: dict[str, Callable[[float, float], float]] = {
    "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": _divide, "%": lambda x, y: np.fmod(x, y) if y else math.nan,
    "ADDNAN": lambda x, y: y if nan(x) else x if nan(y) else x + y, "POW": lambda x, y: np.power(np.float64(x), y), "ATAN2": np.arctan2,
    "LT": _compare(lambda x, y: x < y), "LE": _compare(lambda x, y: x <= y), "GT": _compare(lambda x, y: x > y),
    "GE": _compare(lambda x, y: x >= y), "EQ": _compare(lambda x, y: x == y), "NE": _compare(lambda x, y: x != y),
    "MIN": lambda x, y: math.nan if nan(x) or nan(y) else min(x, y), "MAX": lambda x, y: math.nan if nan(x) or nan(y) else max(x, y),
    "MINNAN": lambda x, y: y if nan(x) else x if nan(y) else min(x, y), "MAXNAN": lambda x, y: y if nan(x) else x if nan(y) else max(x, y),
}


def _of_set(op: str, values: list[float]) -> float:
    real = sorted(v for v in values if not nan(v))
    n = len(real)
    if not n or op == "STDEV" and (n < 2 or any(map(math.isinf, real))):
        return math.nan
    if op == "SMIN":
        return real[0]
    if op == "SMAX":
        return real[-1]
    if op == "MEDIAN":
        return (real[(n - 1) // 2] + real[n // 2]) / 2
    mean = sum(real) / n
    return mean if op == "AVG" else math.sqrt(sum((v - mean) ** 2 for v in real) / (n - 1))


@dataclass
class Node:
    token: tuple[str, object]
    args: list[Node] = field(default_factory=list)
    here: bool = False  # touches PREV, or has no column of its own

    def __post_init__(self) -> None:
        self.here |= any(a.here for a in self.args)

    @property
    def literal(self) -> float | None:
        return self.token[1] if self.token[0] == "number" else None

    def words(self) -> list[tuple[str, object]]:
        """The tokens of a node that is a column."""
        counted = [("number", float(len(self.args)))] if self.token[1] in SETS else []
        return [*(w for a in self.args for w in a.words()), *counted, self.token]


def tree(tokens: list[tuple[str, object]]) -> Node:
    stack: list[Node] = []

    def pop(n: int) -> list[Node]:
        if n < 0 or n > len(stack):
            raise ValueError("RPN stack underflow")
        out = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        return out

    def count() -> int:
        n = pop(1)[0].literal
        if n is None:
            raise ValueError("a count must be a number in the expression")
        return int(n)

    for kind, x in tokens:
        token = (kind, x)
        if kind != "operator" or x in LEAVES:
            stack.append(Node(token))
        elif x == "PREV":
            stack.append(Node(token, here=True))
        elif x in UNARY:
            stack.append(Node(token, pop(1)))
        elif x in BINARY or x in ("TREND", "TRENDNAN"):
            stack.append(Node(token, pop(2)))
        elif x in ("IF", "LIMIT"):
            stack.append(Node(token, pop(3)))
        elif x == "DUP":
            stack += pop(1) * 2
        elif x == "POP":
            pop(1)
        elif x == "EXC":
            stack += pop(2)[::-1]
        elif x == "DEPTH":
            stack.append(Node(("number", float(len(stack)))))
        elif x == "COPY":
            stack += pop(count()) * 2
        elif x == "REV":
            stack += pop(count())[::-1]
        elif x == "INDEX":
            n = count()
            if not 0 <= n <= len(stack):
                raise ValueError("RPN stack underflow")
            stack.append(stack[-n] if n else Node(("number", 0.0)))
        elif x in SETS:
            stack.append(Node(token, pop(count())))
        elif x == "SORT":
            values = pop(count())
            stack += [Node(("sorted", k), values, here=True) for k in range(len(values))]
        elif x == "PERCENT":
            n = count()
            p = pop(1)[0].literal
            if p is None or not 0 <= p <= 100:
                raise ValueError("a percentile is a number from 0 to 100")
            rank, values = math.floor(p * n / 100 + 0.5), pop(n)
            if not rank and not stack:
                raise ValueError("RPN stack underflow")
            stack.append(Node(("sorted", min(rank, n) - 1), values, here=True) if rank else stack[-1])
        elif x in ("PREDICT", "PREDICTSIGMA", "PREDICTPERC"):
            last = pop(3 if x == "PREDICTPERC" else 2)
            k = pop(1)[0]
            if k.literal is None:
                raise ValueError(f"the arguments of {x} must be numbers")
            stack.append(Node(token, [*pop(int(k.literal) if k.literal > 0 else 1), k, *last]))
        else:
            raise ValueError(f"{x} is not available in an expression over PREV")
        if stack and stack[-1].here and str(x).startswith(("TREND", "PREDICT")):
            raise ValueError(f"{x} takes a series, not a value made of PREV")
    if len(stack) != 1:
        raise ValueError("RPN final stack size != 1")
    return stack[0]


class Kernel:
    """A tree as the columns that it needs and a function (their values, last result) -> result."""

    def __init__(self, root: Node) -> None:
        self.parts: list[list[tuple[str, object]]] = []
        self.call = self.compiled(root)

    def compiled(self, node: Node) -> Callable[[tuple, float], float]:
        (kind, x), args = node.token, node.args
        if kind == "number":
            return lambda row, last: x
        if not node.here:
            words = node.words()
            if words not in self.parts:
                self.parts.append(words)
            at = self.parts.index(words)
            return lambda row, last: row[at]
        if x == "PREV":
            return lambda row, last: last
        each = [self.compiled(a) for a in args]
        if kind == "sorted":
            return lambda row, last: sorted((f(row, last) for f in each), key=lambda v: (not nan(v), v))[x]
        if x in SETS:
            return lambda row, last: _of_set(x, [f(row, last) for f in each])
        if x in ONE:
            one, (a,) = ONE[x], each
            return lambda row, last: one(a(row, last))
        if x in TWO:
            two, (a, b) = TWO[x], each
            return lambda row, last: two(a(row, last), b(row, last))
        c, a, b = each
        if x == "IF":
            return lambda row, last: (a if (v := c(row, last)) and not nan(v) else b)(row, last)
        return lambda row, last: v if a(row, last) <= (v := c(row, last)) <= b(row, last) else math.nan  # LIMIT


def recurrence(rows: DataFrame, e: Expression, variables: dict[str, Column], grid: Grid) -> DataFrame:
    """grid.keys, ts, v of an expression over its own previous value, unknown before the first row. A series
    is one Arrow batch, as each row needs the one before; rows: grid.keys, ts and the variables."""
    tokens = list(e.tokens)
    parts = Kernel(tree(tokens)).parts
    names = [f"p{i}" for i in range(len(parts))]
    wide = rows.select(*grid.keys, F.col(grid.ts).alias("ts"), *[Expression(p).column(variables, grid).alias(n) for n, p in zip(names, parts)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        call, last, out = Kernel(tree(tokens)).call, math.nan, []
        values = zip(*(pdf[n].astype("float64").tolist() for n in names)) if names else [()] * len(pdf)
        with np.errstate(all="ignore"):
            for row in values:
                last = float(call(row, last))
                out.append(None if nan(last) else last)
        return pdf[list(grid.keys)].assign(ts=pdf["ts"], v=pd.Series(out, index=pdf.index, dtype="float64"))

    kinds = dict(wide.dtypes)
    return wide.groupBy(*grid.keys).applyInPandas(run, "".join(f"`{k}` {kinds[k]}, " for k in grid.keys) + "ts long, v double")
