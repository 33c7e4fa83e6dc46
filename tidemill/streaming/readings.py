"""Readings as a stream: a state for each series, steps as they are completed, and a store of them.

A series' state is its newest reading and the step that it is in, a few numbers, so state grows with
the number of series and not with time. A reading that is not later than its series' newest is
refused, which needs no watermark. The steps that come out are those of ``operators.ingest`` on the
same readings.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import times
from ..operators.ingest import WRAP_32, WRAP_64
from ..schema import DataSource

#: How long a request id is remembered.
REQUEST_WINDOW = "24 hours"
STATE = "ts long, v string, known double, missing long"


def amount(kind: str, v: str | None, old: str | None, seconds: int) -> float:
    """What a reading adds; NaN if unknown."""
    try:
        if kind in ("GAUGE", "ABSOLUTE"):
            return float(v) * (seconds if kind == "GAUGE" else 1)
        if kind in ("DCOUNTER", "DDERIVE"):
            x, d = float(v), float(v) - float(old)
            return math.nan if kind == "DCOUNTER" and (d < 0 < x or x < 0 < d) else d
        x, y = int(v), int(old)
    except (TypeError, ValueError):
        return math.nan
    if kind == "DERIVE":
        return float(x - y) if (x < 0) == (y < 0) else math.nan
    if x < 0:
        return math.nan
    d = x - y
    for wrap in (WRAP_32, WRAP_64):
        d += wrap if d < 0 else 0
    return float(d)


@dataclass
class Step:
    """The newest reading of a series and what is known of the step that it is in."""

    ts: int
    v: str | None
    known: float = math.nan
    missing: int = 0

    @classmethod
    def opened(cls, ts: int, v: str | None, step: int) -> Step:
        return cls(ts, v, math.nan, ts % step)

    def add(self, known: float, missing: int) -> None:
        if not math.isnan(known):
            self.known = known if math.isnan(self.known) else self.known + known
        self.missing += missing

    def advance(self, ts: int, v: str | None, source: DataSource, step: int) -> Iterator[tuple[int, float]]:
        """The steps that a later reading completes: (end, value), NaN for unknown."""
        seconds = ts - self.ts
        a = amount(source.kind, v, self.v, seconds)
        bounded = float(v) if source.kind == "GAUGE" and not math.isnan(a) else a / seconds
        low, high = (-math.inf if source.low is None else source.low), (math.inf if source.high is None else source.high)
        if seconds > source.heartbeat or not low <= bounded <= high:
            a = math.nan
        rate, unknown = a / seconds, math.isnan(a)
        first, now = self.ts // step, ts // step
        n, span, tail = now - first, now * step - self.ts, ts - now * step
        if n == 0:
            self.add(a, seconds if unknown else 0)
        else:
            lead = span % step
            split = n > 1 and lead >= 1
            part = lead if split else span
            length = step if n == 1 or split else n * step
            left = length - self.missing - (part if unknown else 0)
            total = self.known if unknown else (0.0 if math.isnan(self.known) else self.known) + rate * part
            late = (lead if split else seconds) > source.heartbeat
            whole = 2 * self.missing <= step and not late and left > 0
            yield (first + 1) * step, total / left if whole else math.nan
            for k in range(first + 1, now):
                yield (k + 1) * step, rate
            self.known, self.missing = math.nan if unknown else rate * tail, tail if unknown else 0
        self.ts, self.v = ts, v


def pdps(stream: DataFrame, source: DataSource, step: int, start: int | None = None, key: str = "series", order: str = "ts") -> DataFrame:
    """key, ts (end of the step), v for each completed step of a stream of readings (key, ts, v).

    order: the column of arrival within a batch. Readings not later than all before are dropped.
    Without start a series' first reading opens it.
    """

    def run(name: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Step(*state.get) if state.exists else None if start is None else Step.opened(start, None, step)
        out: list[tuple[int, float]] = []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for ts, v in zip(rows["ts"].tolist(), rows["v"].tolist()):
            v = None if v is None or v != v else v
            if held is None:
                held = Step.opened(ts, v, step)
            elif ts > held.ts:
                out += held.advance(ts, v, source, step)
        if held is not None:
            state.update((held.ts, held.v, held.known, held.missing))
        yield pd.DataFrame({key: [name[0]] * len(out), "ts": [t for t, _ in out], "v": [x for _, x in out]})

    kind = stream.schema[key].dataType.simpleString()
    more = [order] if order not in ("ts", "v", key) else []
    rows = stream.select(key, F.col("ts").cast("long"), F.col("v").cast("string"), *more)
    steps = rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts long, v double", STATE, "append", GroupStateTimeout.NoTimeout)
    return steps.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def newest_only(stream: DataFrame, key: str = "series", order: str = "ts") -> DataFrame:
    """key, ts, v, accepted: whether each reading is later than all before it."""

    def run(name: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        told = []
        for ts in rows["ts"].tolist():
            told.append(last is None or ts > last)
            last = ts if told[-1] else last
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: rows[key], "ts": rows["ts"], "v": rows["v"], "accepted": told})

    kind = stream.schema[key].dataType.simpleString()
    more = [order] if order not in ("ts", "v", key) else []
    rows = stream.select(key, F.col("ts").cast("long"), F.col("v").cast("string"), *more)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts long, v string, accepted boolean", "ts long", "append", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, accepted: str = "accepted_at", request: str = "request_id") -> DataFrame:
    """Each request id counts once within a day of its acceptance."""
    return stream.withWatermark(accepted, REQUEST_WINDOW).dropDuplicatesWithinWatermark([request])


def arguments(lines: DataFrame, names: list[str], template: list[str] | None = None, now: int | None = None, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, ds, ts, v (text) from update arguments ``time:v:v``.

    names: the data sources in order; template: those that the values are for, in their order (a
    later repeat counts); others are unknown. ``N`` is now, a negative time is relative to it, and
    ``time@`` of at-style words is resolved by ``at_time``.
    """
    order = template or names
    if unknown := set(order) - set(names):
        raise ValueError(f"unknown data source name {min(unknown)!r}")
    clock = F.lit(now) if now is not None else F.unix_timestamp()
    at = F.split(F.col(line), ":")
    text = at[0]
    seconds = F.floor(text.try_cast("double")).cast("long")
    ts = F.when(text == "N", clock).when(seconds < 0, clock + seconds).otherwise(seconds)
    place = {n: i for i, n in enumerate(order)}
    given = lambda n: F.when(F.get(at, F.lit(place[n] + 1)) != "U", F.get(at, F.lit(place[n] + 1))) if n in place else F.lit(None).cast("string")
    values = F.array(*(F.struct(F.lit(n).alias("ds"), given(n).alias("v")) for n in names))
    # an argument with a wrong number of values is refused whole
    whole = lines.where(ts.isNotNull() & (F.size(at) == len(order) + 1))
    return whole.select(*keep, ts.alias("ts"), F.explode(values).alias("x")).select(*keep, F.col("x.ds").alias("ds"), "ts", F.col("x.v").alias("v"))


def at_time(argument: str, now: int, zone: str = "UTC") -> str:
    """An argument written with ``@`` with its time in seconds."""
    when, _, values = argument.partition("@")
    return f"{times.instant(when, now, zone)}:{values}"


class Store:
    """Completed steps on their way to a table, and the commands of a write-behind daemon.

    Each batch writes a folder of its own and replaces it if it runs again, so a step is stored once
    whatever fails. Steps of suspended series are stored as waiting and are read once resumed.
    Commands are appended to a table beside the checkpoint, so a store that is opened again knows
    what is suspended and what was forgotten; stored steps are never rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str, key: str = "series") -> None:
        self.spark, self.path, self.checkpoint, self.key = spark, path, checkpoint, key
        self.suspended: set[str] = set()
        self.forgotten: dict[str, int] = {}  # of a series, the last batch whose waiting steps are dropped
        self.query: StreamingQuery | None = None
        self.commands = 0
        try:
            told = spark.read.schema("number long, command string, series string, batch long").parquet(f"{checkpoint}-commands").orderBy("number").collect()
        except AnalysisException:  # no command was given yet
            told = []
        for number, command, series, batch in told:
            self.commands = number + 1
            self._obey(command, series, batch)

    def _obey(self, command: str, series: str, batch: int | None) -> None:
        if command == "suspend":
            self.suspended.add(series)
        elif command == "resume":
            self.suspended.discard(series)
        else:
            self.forgotten[series] = batch

    def _give(self, command: str, names: list[str], batch: int | None = None) -> None:
        if names:
            rows = [(self.commands + i, command, n, batch) for i, n in enumerate(names)]
            self.spark.createDataFrame(rows, "number long, command string, series string, batch long").coalesce(1).write.mode("append").parquet(f"{self.checkpoint}-commands")
            self.commands += len(rows)
            for n in names:
                self._obey(command, n, batch)

    def start(self, steps: DataFrame, every: str | None = None) -> Store:
        """every: how often to write, such as ``300 seconds``; as soon as possible without."""
        writer = steps.writeStream.foreachBatch(self.keep).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(processingTime=every) if every else writer).start()
        return self

    def keep(self, batch: DataFrame, number: int) -> None:
        held = F.col(self.key).isin(*self.suspended) if self.suspended else F.lit(False)
        batch.withColumn("waits", held).write.mode("overwrite").partitionBy("waits").parquet(f"{self.path}/batch={number}")

    def _stored(self) -> DataFrame:
        """All steps but those that were forgotten."""
        every = self.spark.read.parquet(self.path)
        if not self.forgotten:
            return every
        upto = F.create_map(*[F.lit(x) for pair in self.forgotten.items() for x in pair])[F.col(self.key)]
        return every.where(~F.col("waits") | (F.col("batch") > F.coalesce(upto, F.lit(-1))))

    def rows(self) -> DataFrame:
        """What is stored of series that are not suspended; a series' waiting steps are there again
        once it is resumed."""
        every = self._stored()
        return every.where(~F.col("waits") | ~F.col(self.key).isin(*self.suspended)) if self.suspended else every

    def flush(self) -> DataFrame:
        """All that has arrived, stored: reads after it see their own writes."""
        self.query.processAllAvailable()
        return self.rows()

    def suspend(self, *series: str) -> None:
        self._give("suspend", [*series])

    def resume(self, *series: str) -> None:
        """Without names all of them."""
        self._give("resume", sorted(series or self.suspended))

    def pending(self) -> DataFrame:
        """Steps of suspended series."""
        return self._stored().where(F.col("waits") & F.col(self.key).isin(*self.suspended))

    def forget(self, series: str) -> None:
        """Drop the waiting steps of a series: those of all batches up to now are no longer read."""
        last = self.spark.read.parquet(self.path).agg(F.max("batch")).first()[0]
        self._give("forget", [series], last)

    def stats(self) -> dict[str, float]:
        p = self.query.lastProgress
        return {"batches": self.query.recentProgress[-1]["batchId"] + 1 if p else 0, "rows": sum(x["numInputRows"] for x in self.query.recentProgress), "suspended": len(self.suspended)}

    def stop(self) -> None:
        if self.query:
            self.query.stop()
