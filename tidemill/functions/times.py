"""At-style times: ``now-1d``, ``noon yesterday``, ``20030102 13:00``, ``end-3w``.

A specification is a reference and offsets. Days, weeks, months and years move the calendar date
of the reference before it becomes an instant; seconds, minutes and hours are added to the instant.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

#: The words of the language.
CLOCK = {"midnight": 0, "noon": 12, "teatime": 16}
NEAR = {"yesterday": -1, "today": 0, "tomorrow": 1}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
UNITS = {
    "second": ("s", "sec", "second", "seconds"), "minute": ("min", "minute", "minutes"), "hour": ("h", "hr", "hour", "hours"),
    "day": ("d", "day", "days"), "week": ("w", "wk", "week", "weeks"), "month": ("mon", "month", "months"), "year": ("y", "yr", "year", "years"),
}
SECONDS = {"second": 1, "minute": 60, "hour": 3600}
#: Numbers above this are seconds since the epoch.
EPOCH_FROM = 315360000
#: The year of a date without one after a numeric time of day.
NO_YEAR = 30000

_MONTH = {w: i + 1 for i, m in enumerate(MONTHS) for w in (m, m[:3])}
_DAY = {w: i for i, d in enumerate(DAYS) for w in (d, d[:3])}
_UNIT = {w: u for u, words in UNITS.items() for w in words}
_TOKEN = re.compile(r"[ \t\n_,]*(?:(?P<number>[0-9]+)|(?P<word>[A-Za-z]+)|(?P<sign>[-+:./]))")


def zone_of(name: str) -> ZoneInfo:
    """Unknown and empty names are UTC."""
    try:
        return ZoneInfo(name or "UTC")
    except (ZoneInfoNotFoundError, ValueError):
        return ZoneInfo("UTC")


def _i32(n: int) -> int:
    return ((n + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)


def _amount(text: str) -> int:
    return _i32(min(int(text), (1 << 63) - 1))


@dataclass
class Moment:
    """A parsed specification: an anchor (start or end) or an instant or a local date and time."""

    anchor: str | None = None
    instant: int | None = None
    local: list[int] | None = None
    calendar: dict[str, int] = field(default_factory=lambda: {"day": 0, "month": 0, "year": 0})
    seconds: int = 0

    def at(self, zone: str, anchor: int | None = None) -> int:
        tz = zone_of(zone)
        base = anchor if self.anchor else self.instant
        moved = any(self.calendar.values())
        if base is not None and not moved:
            return base + self.seconds
        offset = None
        if base is not None:  # the offset in force at the instant stays
            offset = datetime.fromtimestamp(base, tz).utcoffset()
            fields = list((datetime.fromtimestamp(base, UTC).replace(tzinfo=None) + offset).timetuple()[:6])
        else:
            fields = list(self.local)
        fields[0] += self.calendar["year"]
        fields[1] += self.calendar["month"]
        fields[2] += self.calendar["day"]
        return _instant(fields, tz, offset) + self.seconds


def _instant(fields: list[int], tz: ZoneInfo, offset: timedelta | None) -> int:
    year, month, day, hour, minute, second = fields
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    # 400 years have the same calendar and, beyond the tables, the same rules
    cycles, near = 0, year
    if not 1800 <= year <= 9000:
        near = 2000 + year % 400
        cycles = (year - near) // 400
    naive = datetime(near, month, 1) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second)
    if offset is None:
        offset = naive.replace(tzinfo=tz).utcoffset()
    return int((naive.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC) - offset).total_seconds()) + cycles * 146097 * 86400


class _Parser:
    def __init__(self, text: str, now: int, zone: str) -> None:
        self.text, self.at, self.tokens = text, 0, []
        pos = 0
        while m := _TOKEN.match(text, pos):
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            pos = m.end()
        self.now, today = now, datetime.fromtimestamp(now, zone_of(zone))
        self.local = list(today.timetuple()[:6])
        self.weekday = (today.weekday() + 1) % 7

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        kind, text, _ = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "", 0)
        return kind, text.lower()

    def take(self, *texts: str) -> str | None:
        if self.peek()[1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def number(self) -> str | None:
        if self.peek()[0] == "number":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self) -> Moment:
        out = self.reference()
        self.offsets(out)
        if self.at < len(self.tokens):
            raise ValueError(f"unparsable trailing text: '...{self.text[self.tokens[self.at][2] :]}'")
        return out

    def reference(self) -> Moment:
        kind, word = self.peek()
        if word in ("+", "-") and kind == "sign":
            return Moment(local=self.local)
        if kind == "number":
            if self.is_hour():
                return self.time_first(numeric=True)
            return self.date_first()
        if kind == "word":
            if word in ("now", "n"):
                self.at += 1
                if self.peek()[1] not in ("", "+", "-"):
                    raise ValueError("if 'now' is followed by a token it must be +|- offset")
                return Moment(local=self.local)
            if word in ("start", "s", "end", "e", "epoch"):
                self.at += 1
                if self.peek()[1] not in ("+", "-"):
                    raise ValueError("'start' or 'end' MUST be followed by +|- offset")
                if word == "epoch":
                    return Moment(local=[1899, 12, 31, 0, 0, 0])
                return Moment(anchor="start" if word[0] == "s" else "end")
            if word in CLOCK:
                return self.time_first(numeric=False)
            if word in _MONTH:
                return self.date_first()
        raise ValueError(f"unparsable time: {self.text}")

    # times of day

    def is_hour(self) -> bool:
        kind, text = self.peek()
        return kind == "number" and len(text) <= 2 and int(text) <= 23 and self.peek(1)[1] not in ("/", ".")

    def clock(self) -> tuple[int, int]:
        hour, minute = int(self.number()), 0
        if self.take(":"):
            text = self.number()
            if text is None:
                raise ValueError("Parsing HH:MM syntax, expecting MM as number, got none")
            minute = _amount(text)
            if minute > 59:
                raise ValueError(f"parsing HH:MM syntax, got MM = {minute} (>59!)")
        half = self.take("am", "pm")
        if half:
            if hour > 12:
                raise ValueError("there cannot be more than 12 AM or PM hours")
            hour = hour % 12 + (12 if half == "pm" else 0)
        return hour, minute

    def time_first(self, numeric: bool) -> Moment:
        if numeric:
            hour, minute = self.clock()
        else:
            hour, minute = CLOCK[self.take(*CLOCK)], 0
        local = [*self.local[:3], hour, minute, 0]
        kind, word = self.peek()
        if word in NEAR:
            self.at += 1
            local[2] += NEAR[word]
        elif word in _DAY:
            self.at += 1
            local[2] += _DAY[word] - self.weekday
        elif kind == "number" or word in _MONTH:
            date = self.date()
            if isinstance(date, int):
                return Moment(instant=date)
            year, month, day, _ = date
            local[:3] = [year if year is not None else NO_YEAR if numeric else self.local[0], month, day]
        return Moment(local=local)

    # dates

    def date_first(self) -> Moment:
        date = self.date()
        if isinstance(date, int):
            return Moment(instant=date)
        year, month, day, named = date
        clock = self.local[3:] if named else [0, 0, 0]
        if self.is_hour():
            clock = [*self.clock(), 0]
        elif self.take("am", "pm"):
            clock = [0, 0, 0]
        elif not named:
            self.take("+", "-")
        return Moment(local=[self.local[0] if year is None else year, month, day, *clock])

    def date(self) -> int | tuple[int | None, int, int, bool]:
        """Seconds since the epoch, or (year or None, month, day, by name)."""
        kind, word = self.peek()
        if word in _MONTH:
            self.at += 1
            day = self.number()
            if day is None:
                raise ValueError("the day of the month should follow month name")
            year = self.number()
            return None if year is None else self.year(year), _MONTH[word], _amount(day), True
        text = self.number()
        n = int(text)
        if n > EPOCH_FROM:
            if n >= (1 << 63) - 1:
                raise ValueError("the specified time is incorrect (out of range?)")
            return n
        year: int | None = None
        if 19700101 < n < 24000101:
            year, month, day = int(text[:4]), int(text[4:6]), int(text[6:])
        elif mark := self.take("/", "."):
            second = self.number()
            if second is None:
                raise ValueError(f"there should be {'day' if mark == '/' else 'month'} number after '{mark}'")
            month, day = (n, int(second)) if mark == "/" else (int(second), n)
            if mark == "." and day > 31:
                raise ValueError(f"did you really mean month {day}?")
            self.check(month, day)
            if self.take(mark):
                later = self.number()
                if later is None:
                    raise ValueError(f"there should be year number after '{mark}'")
                year = self.year(later)
        else:
            month, day = n, 0
        self.check(month, day)
        return year, month, day, False

    @staticmethod
    def check(month: int, day: int) -> None:
        if not 1 <= month <= 12:
            raise ValueError(f"did you really mean month {month}?")
        if not 1 <= day <= 31:
            raise ValueError(f"I'm afraid that {day} is not a valid day of the month")

    @staticmethod
    def year(text: str) -> int:
        n = _amount(text)
        if n > 1970:
            return n
        if not 0 <= n <= 138:
            raise ValueError(f"invalid year {n} (should be either 00-99 or >1900)")
        if 38 <= n < 70:
            raise ValueError("won't handle dates before epoch (01/01/1970), sorry")
        return n + (2000 if n < 38 else 1900)

    # offsets

    def offsets(self, out: Moment) -> None:
        while mark := self.take("+", "-"):
            sign, last = -1 if mark == "-" else 1, None
            if self.peek()[0] != "number":
                raise ValueError(f"There should be number after '{mark}'")
            while text := self.number():
                n, unit = _amount(text), "second"
                kind, word = self.peek()
                if kind != "end":
                    self.at += 1  # whatever follows a number is its unit
                    if word == "m" and kind == "word":
                        unit = last = self.month_or_minute(last, n)
                    elif kind == "word" and word in _UNIT:
                        unit = last = _UNIT[word]
                if unit in SECONDS:
                    out.seconds += sign * _i32(n * SECONDS[unit])
                elif unit == "week":
                    out.calendar["day"] += sign * 7 * n
                else:
                    out.calendar[unit] += sign * n

    @staticmethod
    def month_or_minute(last: str | None, n: int) -> str:
        if last is None:
            return "month" if n < 6 else "minute"
        return "minute" if last in SECONDS else "month"


def parse(text: str, now: int, zone: str = "UTC") -> Moment:
    return _Parser(text, now, zone).parse()


def instant(text: str, now: int, zone: str = "UTC") -> int:
    """One time on its own."""
    moment = parse(text, now, zone)
    if moment.anchor:
        raise ValueError("specifying time relative to the 'start' or 'end' makes no sense here")
    return moment.at(zone)


def window(start: str, end: str, now: int, zone: str = "UTC") -> tuple[int, int]:
    """(start, end) of two specifications that may refer to each other."""
    parsed = []
    for name, text in (("start", start), ("end", end)):
        try:
            parsed.append(parse(text, now, zone))
        except ValueError as e:
            raise ValueError(f"{name} time: {e}") from None
    s, e = parsed
    if s.anchor == "start":
        raise ValueError("the start time cannot be specified relative to itself")
    if e.anchor == "end":
        raise ValueError("the end time cannot be specified relative to itself")
    if s.anchor and e.anchor:
        raise ValueError("the start and end times cannot be specified relative to each other")
    if s.anchor:
        last = e.at(zone)
        first = s.at(zone, last)
    else:
        first = s.at(zone)
        last = e.at(zone, first)
    if first > last:
        raise ValueError(f"start ({first}) should be less than end ({last})")
    return first, last
