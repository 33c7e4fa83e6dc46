"""Seasonal forecasting (Holt-Winters) with aberrant-behaviour flags.

Each step depends on the one before, so a series runs in time order within one task; only its state
is held, however long it is. Series are independent and spread over the cluster. The same step
function serves streams.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import Database


@dataclass(frozen=True)
class Model:
    period: int
    alpha: float = 0.1
    beta: float = 0.0035
    gamma: float = 0.1
    deviation_gamma: float | None = None
    multiplicative: bool = False
    delta_pos: float = 2.0
    delta_neg: float = 2.0
    window: int = 9
    threshold: int = 7
    smoothing: float = 0.05

    @classmethod
    def of(cls, db: Database) -> Model:
        """The model that a database's archives describe."""
        first = {a.cf: a for a in reversed(db.archives)}
        main = first.get("HWPREDICT") or first.get("MHWPREDICT")
        if main is None:
            raise ValueError("no archive predicts")
        season, deviation, failures = (first[k].params if k in first else {} for k in ("SEASONAL", "DEVSEASONAL", "FAILURES"))
        own = {k: failures[k] for k in ("delta_pos", "delta_neg", "window", "threshold") if k in failures}
        return cls(main.params["period"], main.params["alpha"], main.params["beta"], season.get("gamma", 0.1), deviation.get("gamma"), main.cf == "MHWPREDICT", smoothing=season.get("smoothing_window", 0.05), **own)

    def remove(self, a: float, b: float) -> float:
        if not self.multiplicative:
            return a - b
        return a / b if b > 0 else math.nan

    def apply(self, a: float, b: float) -> float:
        return a * b if self.multiplicative else a + b


def blend(weight: float, new: float, old: float) -> float:
    return weight * new + (1 - weight) * old


@dataclass
class State:
    """What a series carries from step to step; unknown is NaN."""

    level: float = math.nan
    trend: float = math.nan
    gap: int = 1
    season: list[float] = field(default_factory=list)
    deviation: list[float] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)
    at: int = 0
    seasons: int = 0
    ahead: int = 0  # rows between the next one and the one whose coefficients it reads

    def open(self, m: Model) -> None:
        if not self.season:
            self.season, self.deviation, self.flags = [math.nan] * m.period, [math.nan] * m.period, [0] * m.window

    def move(self, steps: int) -> None:
        self.seasons += (self.at + steps) // len(self.season)
        self.at = (self.at + steps) % len(self.season)

    def run(self, values: list[float], m: Model) -> list[tuple[float, float, float, float, float]]:
        """The rows of the PDPs that one reading closed: a single one learns and writes its season
        row; of two each learns but writes none, and the next coefficients are read a row further;
        three or more teach nothing, keep their season rows and empty the history of failures."""
        self.open(m)
        if len(values) < 3:
            return [self.step(x, m, len(values) == 2) for x in values]
        out = []
        for _ in values:
            out.append((math.nan, self.season[self.at], self.deviation[self.at], math.nan, 0.0))
            self.move(1)
        self.gap, self.flags, self.ahead = self.gap + len(values), [0] * m.window, 0
        return out

    def step(self, x: float, m: Model, pair: bool = False) -> tuple[float, float, float, float, float]:
        """(prediction, new seasonal coefficient, new deviation, deviation used, failure)."""
        self.open(m)
        look, nan = (self.at + self.ahead) % m.period, math.isnan
        s, d = self.season[look], self.deviation[look]
        p = guess = math.nan
        if nan(self.level):
            new = s
            if not nan(x):
                self.level, self.trend, self.gap = x, 0.0, 1
                guess = math.nan if nan(s) else m.apply(x, s)
                fresh = m.remove(x, self.level)
                new = fresh if nan(s) else blend(m.gamma, fresh, s)
        elif nan(self.trend):
            new = s if nan(x) else math.nan
        elif nan(s):
            new = m.remove(x, self.level)
        else:
            base = self.level + self.gap * self.trend
            p = guess = m.apply(base, s)
            if nan(x):
                self.gap, new = self.gap + 1, s
            else:
                before = self.level
                self.level = blend(m.alpha, m.remove(x, s), base)
                self.trend = blend(m.beta, self.level - before, self.trend)
                new, self.gap = blend(m.gamma, m.remove(x, self.level), s), 1
        gamma = m.gamma if m.deviation_gamma is None else m.deviation_gamma
        off = abs(x - guess)
        new_d = math.nan if nan(guess) else d if nan(x) else off if nan(d) else blend(gamma, off, d)
        wrong = not nan(d) and (nan(x) or x > guess + m.delta_pos * d or x < guess - m.delta_neg * d)
        self.flags = [int(wrong), *self.flags[: m.window - 1]]
        failure = float(sum(self.flags) >= m.threshold)
        if not pair:
            self.season[self.at], self.deviation[self.at] = new, new_d
        self.ahead = int(pair)
        self.move(1)
        return p, new, new_d, d, failure

    def reset(self) -> None:
        """Forget what was learnt, as after a change of what is measured; the place in the season stays."""
        n, w = len(self.season), len(self.flags)
        self.level = self.trend = math.nan
        self.gap, self.season, self.deviation, self.flags = 1, [math.nan] * n, [math.nan] * n, [0] * w

    def smooth(self, m: Model) -> None:
        """Centred circular means of both seasonal rows; the additive season is centred on 0 and
        the multiplicative one on 1; the level gains the mean that the season lost. Rows of which
        one is unknown stay."""
        half = int(m.smoothing / 2 * m.period)
        for rows, is_season in ((self.season, True), (self.deviation, False)):
            if not rows or any(map(math.isnan, rows)):
                continue
            if half:
                n = len(rows)
                rows[:] = [sum(rows[(i + k) % n] for k in range(-half, half + 1)) / (2 * half + 1) for i in range(n)]
            if is_season:
                mean = sum(rows) / len(rows)
                rows[:] = [m.remove(r, mean) for r in rows]
                self.level += mean


FORECAST = "ts long, v double, predicted double, seasonal double, deviation double, devpredict double, failure double"
STATE = "level double, trend double, gap long, at long, season array<double>, deviation array<double>"


def _number(x: float) -> float | None:
    return None if math.isnan(x) else x


def _by_series(pdp: DataFrame, keys: tuple[str, ...], schema: StructType, visit: Callable) -> DataFrame:
    """visit(key, runs) -> rows of each series in time order. runs: (ts list, value list) of the
    PDPs that one reading closed; without a column ``run`` in pdp each PDP is a reading's own."""
    of_run = F.col("run") if "run" in pdp.columns else F.lit(1).alias("run")
    rows = pdp.select(*keys, "ts", "v", of_run)
    # partitions by key as the session has them; only a run is held at a time
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "ts")
    arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()]) for f in schema])

    def series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(zip(*(batch[k].to_pylist() for k in keys)), batch["ts"].to_pylist(), batch["v"].to_pylist(), batch["run"].to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, source = [], series(batches)
        ahead = next(source, None)
        while ahead is not None:
            key = ahead[0]

            def runs():
                nonlocal ahead
                while ahead is not None and ahead[0] == key:
                    _, ts, v, left = ahead
                    when, values = [ts], [v]
                    ahead = next(source, None)
                    while len(when) < left and ahead is not None and ahead[0] == key:
                        when.append(ahead[1]), values.append(ahead[2])
                        ahead = next(source, None)
                    yield when, [math.nan if x is None else x for x in values]

            for row in visit(key, runs()):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def _schema(pdp: DataFrame, keys: tuple[str, ...], rest: str) -> StructType:
    kinds = dict(pdp.dtypes)
    return StructType.fromDDL(", ".join([*(f"`{k}` {kinds[k]}" for k in keys), rest]))


def forecast(pdp: DataFrame, model: Model, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys and, for each PDP, the rows of the five archives: predicted (null while learning),
    seasonal, deviation (after), devpredict (before) and failure."""

    def visit(key: tuple, runs) -> Iterator[tuple]:
        state = State()
        for when, values in runs:
            for ts, x, row in zip(when, values, state.run(values, model)):
                yield *key, ts, _number(x), *map(_number, row)

    return _by_series(pdp, keys, _schema(pdp, keys, FORECAST), visit)


def states(pdp: DataFrame, model: Model, keys: tuple[str, ...] = ("series",), smooth: bool = True) -> DataFrame:
    """keys and what a series carries on after its last PDP: level, trend, gap, place in the season,
    season and deviation rows. With smooth after one smoothing pass, as after an update command in
    which the season came round."""

    def visit(key: tuple, runs) -> Iterator[tuple]:
        state = State()
        for _, values in runs:
            state.run(values, model)
        if smooth and state.seasons:
            state.smooth(model)
        yield *key, _number(state.level), _number(state.trend), state.gap, state.at, [*map(_number, state.season)], [*map(_number, state.deviation)]

    return _by_series(pdp, keys, _schema(pdp, keys, STATE), visit)
