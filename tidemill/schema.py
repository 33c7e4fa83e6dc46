"""Databases, data sources and archives: what is fixed when a database is created."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: Kinds of data sources and consolidation functions.
KINDS = ("GAUGE", "COUNTER", "DERIVE", "DCOUNTER", "DDERIVE", "ABSOLUTE", "COMPUTE")
BASIC = ("AVERAGE", "MIN", "MAX", "LAST")
SEASONAL_KINDS = ("HWPREDICT", "MHWPREDICT", "SEASONAL", "DEVSEASONAL", "DEVPREDICT", "FAILURES")
#: Seconds of each duration suffix.
SUFFIXES = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2678400, "y": 31622400}

#: The archives that each tuning option is for, and its name among their parameters.
TUNING = {
    "alpha": (("HWPREDICT", "MHWPREDICT"), "alpha"), "beta": (("HWPREDICT", "MHWPREDICT"), "beta"),
    "gamma": (("SEASONAL",), "gamma"), "gamma-deviation": (("DEVSEASONAL",), "gamma"),
    "smoothing-window": (("SEASONAL",), "smoothing_window"), "smoothing-window-deviation": (("DEVSEASONAL",), "smoothing_window"),
    "deltapos": (("FAILURES",), "delta_pos"), "deltaneg": (("FAILURES",), "delta_neg"),
    "window-length": (("FAILURES",), "window"), "failure-threshold": (("FAILURES",), "threshold"),
}

_NAME = re.compile(r"[A-Za-z0-9_-]{1,19}\Z")


def duration(text: str, divisor: int = 1) -> int:
    """Whole units of ``divisor`` seconds: a bare number counts units, one with a suffix time."""
    m = re.fullmatch(r"(\d+)([smhdwMy]?)", text)
    if not m or int(m[1]) == 0:
        raise ValueError(f"not a duration: {text!r}")
    if not m[2]:
        return int(m[1])
    seconds = int(m[1]) * SUFFIXES[m[2]]
    if seconds % divisor:
        raise ValueError(f"{text!r} is no multiple of {divisor} s")
    return seconds // divisor


def _bound(text: str) -> float | None:
    return None if text == "U" else float(text)


@dataclass(frozen=True)
class DataSource:
    name: str
    kind: str = "GAUGE"
    heartbeat: int = 600
    low: float | None = None
    high: float | None = None
    cdef: str | None = None

    def __post_init__(self) -> None:
        if not _NAME.match(self.name):
            raise ValueError(f"not a data source name: {self.name!r}")
        if self.kind not in KINDS:
            raise ValueError(f"unknown data source type {self.kind!r}")
        if self.low is not None and self.high is not None and self.low >= self.high:
            raise ValueError("min must be less than max")

    @classmethod
    def parse(cls, word: str) -> DataSource:
        """``DS:name:KIND:heartbeat:min:max`` or ``DS:name:COMPUTE:rpn``."""
        tag, name, kind, *rest = word.split(":", 3)
        if tag != "DS":
            raise ValueError(f"not a DS word: {word!r}")
        if kind == "COMPUTE":
            return cls(name, kind, 0, cdef=rest[0])
        heartbeat, low, high = rest[0].split(":")
        return cls(name, kind, duration(heartbeat), _bound(low), _bound(high))


@dataclass(frozen=True)
class Archive:
    cf: str
    xff: float = 0.5
    pdp_per_row: int = 1
    rows: int = 1
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.cf not in BASIC + SEASONAL_KINDS:
            raise ValueError(f"unrecognized consolidation function {self.cf!r}")
        if not 0 <= self.xff < 1 or self.pdp_per_row < 1 or self.rows < 1:
            raise ValueError("xff is in [0, 1); steps and rows are at least 1")

    @classmethod
    def parse(cls, word: str, step: int = 300) -> list[Archive]:
        """``RRA:CF:xff:steps:rows``, or ``RRA:HWPREDICT:rows:alpha:beta:period`` (and MHWPREDICT),
        which adds the archives that it depends on."""
        tag, cf, *rest = word.split(":")
        if tag != "RRA":
            raise ValueError(f"not an RRA word: {word!r}")
        if cf in BASIC:
            k = duration(rest[1], step)
            return [cls(cf, float(rest[0]), k, duration(rest[2], step * k))]
        if cf not in ("HWPREDICT", "MHWPREDICT"):
            raise ValueError(f"{cf} follows from a prediction archive")
        rows, alpha, beta, period = int(rest[0]), float(rest[1]), float(rest[2]), int(rest[3])
        return [
            cls(cf, 0.0, 1, rows, {"alpha": alpha, "beta": beta, "period": period}),
            cls("SEASONAL", 0.0, 1, period, {"gamma": alpha, "smoothing_window": 0.05}),
            cls("DEVSEASONAL", 0.0, 1, period, {"gamma": alpha, "smoothing_window": 0.05}),
            cls("DEVPREDICT", 0.0, 1, rows),
            cls("FAILURES", 0.0, 1, period, {"threshold": 7, "window": 9, "delta_pos": 2.0, "delta_neg": 2.0}),
        ]


@dataclass(frozen=True)
class Database:
    """step seconds; start: the time before the first reading; last_update grows with readings."""

    step: int = 300
    sources: tuple[DataSource, ...] = ()
    archives: tuple[Archive, ...] = ()
    start: int | None = None
    last_update: int | None = None

    @classmethod
    def create(cls, words: list[str], step: int = 300, start: int | None = None) -> Database:
        sources, archives = [], []
        for w in words:
            if w.startswith("DS:"):
                sources.append(DataSource.parse(w))
            else:
                archives += Archive.parse(w, step)
        if not sources or not archives:
            raise ValueError("a database has at least one DS and one RRA")
        if len({s.name for s in sources}) < len(sources):
            raise ValueError("a DS name occurs twice")
        return cls(step, tuple(sources), tuple(archives), start, start)

    # structure changes: each gives a new definition; operators.admin moves the rows
    def tuned(self, name: str, **changes) -> Database:
        """One data source with changed heartbeat, low, high, kind or name."""
        if name not in [s.name for s in self.sources]:
            raise ValueError(f"unknown data source name {name!r}")
        return replace(self, sources=tuple(replace(s, **changes) if s.name == name else s for s in self.sources))

    def forecast_tuned(self, option: str, value: float) -> Database:
        """One parameter of the forecast, in the first archive of its kind."""
        kinds, name = TUNING[option]
        at = next((i for i, a in enumerate(self.archives) if a.cf in kinds), None)
        if at is None:
            raise ValueError(f"no archive has a parameter {option!r}")
        if name in ("window", "threshold"):
            held = self.archives[at].params | {name: int(value)}
            if not 1 <= int(value) <= 28 or held["threshold"] > held["window"]:
                raise ValueError("the failure window is 1 to 28 and no shorter than the threshold")
        elif name.startswith("delta"):
            if value < 0:
                raise ValueError("a delta is not negative")
        elif not 0 <= value <= 1:
            raise ValueError("Holt-Winters parameter must be between 0 and 1")
        new = int(value) if name in ("window", "threshold") else float(value)
        return replace(self, archives=tuple(replace(a, params=a.params | {name: new}) if i == at else a for i, a in enumerate(self.archives)))

    def without_source(self, name: str) -> Database:
        return replace(self, sources=tuple(s for s in self.sources if s.name != name))

    def resized(self, index: int, rows: int) -> Database:
        return replace(self, archives=tuple(replace(a, rows=a.rows + rows) if i == index else a for i, a in enumerate(self.archives)))

    def restepped(self, factor: int) -> Database:
        """step / factor; archives keep their resolution."""
        if factor < 1 or self.step % factor:
            raise ValueError("the new step must divide the old one")
        return replace(self, step=self.step // factor, archives=tuple(replace(a, pdp_per_row=a.pdp_per_row * factor) for a in self.archives))
