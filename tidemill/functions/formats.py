"""Texts of values: PRINT formats with SI prefixes, times, durations."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime

from . import times

#: The pattern of a value format, and the prefixes of powers -6 to 6.
PATTERN = r"^(?:[^%]+|%%)*%[-+ 0#]?[0-9]*(?:[.][0-9]+)?l[eEfFgG](?:[^%]+|%%)*(?:%[sS])?(?:[^%]+|%%)*$"
PREFIXES = "afpnum kMGTPE"
#: What stands for each conversion of a time that is not there; others are one dash.
MISSING = {
    "%": "%", " ": "% ", ".": "%.", "@": "%@", "n": "\r\n", "t": "\t", "j": "---", "D": "--/--/--", "F": "-" * 10, "R": "--:--", "T": "--:--:--",
    **dict.fromkeys("dgmyCHIMSUVW", "--"), **dict.fromkeys("GY", "----"),
}
DURATION, TIME = "%H:%02m:%02s", "%Y-%m-%d %H:%M:%S"

_CONVERSION = re.compile(r"%%|%s|%([-+ 0#]?[0-9]*(?:[.][0-9]+)?)l([eEfFgG])")
_DURATION = re.compile(r"%(0?)([0-9]*)(?:[.]([0-9]+))?([WdDhHmMsSf%])|%")
#: Milliseconds of each letter's unit, and the range of those that count within a larger one.
_UNITS = {"W": (604800000, None), "d": (86400000, 7), "D": (86400000, None), "h": (3600000, 24), "H": (3600000, None), "m": (60000, 60), "M": (60000, None), "s": (1000, 60), "S": (1000, None), "f": (1, 1000)}


def power_of(value: float, base: int = 1000) -> float:
    if value == 0 or math.isnan(value):
        return 0
    return math.inf if math.isinf(value) else math.floor(math.log(abs(value)) / math.log(base))


def prefix(power: float) -> str:
    return PREFIXES[int(power) + 6] if -6 <= power <= 6 else "?"


def number(template: str, value: float | None, base: int = 1000, kept: float | None = None) -> tuple[str, float | None]:
    """(text, power): kept is the power that an earlier format chose, which ``%S`` takes over."""
    value = math.nan if value is None else value
    again = "%S" in template
    template = template.replace("%S", "%s", 1)
    if not re.match(PATTERN, template):
        raise ValueError(f"invalid format string '{template}' (should match '{PATTERN}')")
    mark = " "
    if "%s" in template.replace("%%", ""):
        power = kept if again and kept is not None else power_of(value, base)
        if not (again and kept is None and value == 0):
            kept = power
        mark = prefix(power)
        value = math.nan if math.isinf(power) else value / float(base) ** power

    def put(m: re.Match) -> str:
        if m[0] == "%%":
            return "%"
        return mark if m[0] == "%s" else f"%{m[1]}{m[2]}" % value

    return _CONVERSION.sub(put, template), kept


def _plain(value: float | None) -> str | None:
    if value is None or math.isnan(value):
        return "nan"
    return ("inf" if value > 0 else "-inf") if math.isinf(value) else None


def duration(template: str, ms: float | None) -> str:
    """A number of milliseconds; fractions are cut, not rounded."""
    if (odd := _plain(ms)) is not None:
        return odd
    whole = int(abs(ms))

    def put(m: re.Match) -> str:
        zero, width, digits, letter = m.groups()
        if letter is None:
            raise ValueError("Wrong duration format")
        if letter == "%":
            return "%"
        unit, within = _UNITS[letter]
        left = whole % (unit * within) if within else whole
        text = str(left // unit)
        if digits and int(digits):
            places = int(digits)
            text += f".{left % unit * 10**places // unit:0{places}d}"
        return text.rjust(int(width or 0), "0" if zero else " ")

    return ("-" if ms < 0 else "") + _DURATION.sub(put, template or DURATION)


def time_of_value(template: str, value: float | None) -> str:
    """The value as seconds since the epoch, in UTC."""
    if (odd := _plain(value)) is not None:
        return odd
    try:
        return datetime.fromtimestamp(int(value), UTC).strftime(template or TIME)
    except (ValueError, OverflowError, OSError):
        return f"{value:.0f}"


def time(template: str, seconds: int | None, zone: str = "UTC") -> str:
    """A time in the zone; dashes stand for a missing one."""
    if seconds is None:
        return re.sub(r"%(?:[EO].?|(.)|$)", lambda m: MISSING.get(m[1], "-"), template, flags=re.DOTALL)
    return datetime.fromtimestamp(seconds, times.zone_of(zone)).strftime(template)
