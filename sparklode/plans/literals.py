"""Sizes and dates of the query language, resolved to bounds before planning."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language's keywords, units and formats.
KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
SIZE_WORDS = {
    "empty": (0, 0),
    "tiny": (1, 10 * KIB),
    "small": (10 * KIB + 1, 100 * KIB),
    "medium": (100 * KIB + 1, MIB),
    "large": (MIB + 1, 100 * MIB),
    "huge": (100 * MIB + 1, GIB),
    "gigantic": (GIB + 1, None),
    "giant": (GIB + 1, None),
}
UNITS = "bkmgtp"
UNIT_NAMES = {"b": "bytes?", "k": "kilobytes?", "m": "megabytes?", "g": "gigabytes?", "t": "terabytes?", "p": "petabytes?"}
AMOUNT = re.compile(r"([0-9]+(?:\.[0-9]+)?)(?:(" + "|".join(f"{u}ib|{u}b|{n}|{u}" if u != "b" else f"{n}|b" for u, n in UNIT_NAMES.items()) + "))?")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "dd-MM-yyyy", "MM/dd/yyyy")
_DATES = (re.compile(r"(?P<y>\d{4})([-/.])(?P<m>\d\d)\2(?P<d>\d\d)"), re.compile(r"(?P<d>\d\d)-(?P<m>\d\d)-(?P<y>\d{4})"), re.compile(r"(?P<m>\d\d)/(?P<d>\d\d)/(?P<y>\d{4})"))
COMPARISONS = (">=", "<=", "!=", ">", "<", "=")


class QueryError(ValueError):
    """The query text has no meaning; the whole query is invalid."""


def byte_count(text: str) -> int:
    m = AMOUNT.fullmatch(text.strip())
    if not m:
        raise QueryError(f"not a size: {text!r}")
    factor = 1 << (10 * UNITS.index((m[2] or "b")[0]))
    return int((Decimal(m[1]) * factor).to_integral_value(ROUND_HALF_UP))


def calendar_day(text: str) -> datetime:
    for pattern in _DATES:
        if m := pattern.fullmatch(text):
            try:
                return datetime(int(m["y"]), int(m["m"]), int(m["d"]))
            except ValueError:
                break
    raise QueryError(f"not a date: {text!r}")


@dataclass(frozen=True)
class Bounds:
    """``low <op> x <op> high``; None is open. ``negated`` turns it round."""

    low: object = None
    high: object = None
    low_open: bool = False
    high_open: bool = False
    negated: bool = False

    def on(self, x: Column) -> Column:
        tests = []
        if self.low is not None:
            tests.append(x > F.lit(self.low) if self.low_open else x >= F.lit(self.low))
        if self.high is not None:
            tests.append(x < F.lit(self.high) if self.high_open else x <= F.lit(self.high))
        both = tests[0] & tests[1] if len(tests) == 2 else tests[0]
        return ~both if self.negated else both


def _compared(op: str, low, high, span) -> Bounds:
    """Bounds of ``x op low``; ``span`` is what equality means."""
    return {
        ">": Bounds(low=low, low_open=True),
        ">=": Bounds(low=low),
        "<": Bounds(high=low, high_open=True),
        "<=": Bounds(high=low),
        "=": span,
        "!=": Bounds(span.low, span.high, span.low_open, span.high_open, True),
    }[op]


def size_test(raw: str) -> Bounds:
    text = raw.strip().lower()
    if text in SIZE_WORDS:
        return Bounds(*SIZE_WORDS[text])
    if ".." in text:
        low, high = (byte_count(x) for x in text.split("..", 1))
        if low > high:
            raise QueryError(f"empty range: {raw!r}")
        return Bounds(low, high)
    op = next((o for o in COMPARISONS if text.startswith(o)), "")
    n = byte_count(text[len(op) :])
    return _compared(op or "=", n, None, Bounds(n, n))


def _month(start: datetime, by: int) -> datetime:
    """The same day ``by`` months on, or the month's last."""
    at = start.year * 12 + start.month - 1 + by
    year, month = divmod(at, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return start.replace(year=year, month=month + 1, day=min(start.day, last))


def date_test(raw: str, now: datetime, first_weekday: int = 6) -> Bounds:
    """``now`` is in the session's zone; ``first_weekday`` as in ``datetime.weekday`` (6: Sunday)."""
    text = raw.strip().lower()
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    week = today - timedelta(days=(today.weekday() - first_weekday) % 7)
    month, year = today.replace(day=1), today.replace(month=1, day=1)
    day, seven = timedelta(days=1), timedelta(days=7)
    spans = {
        "today": (today, today + day),
        "yesterday": (today - day, today),
        "thisweek": (week, week + seven),
        "lastweek": (week - seven, week),
        "thismonth": (month, _month(month, 1)),
        "lastmonth": (_month(month, -1), month),
        "thisyear": (year, _month(year, 12)),
        "lastyear": (_month(year, -12), year),
        "pastweek": (now - seven, now),
        "pastmonth": (_month(now, -1), now),
        "pastyear": (_month(now, -12), now),
    }
    if text in spans:
        return Bounds(*spans[text], high_open=True)
    if ".." in text:
        low, high = (calendar_day(x) for x in text.split("..", 1))
        if low >= high + day:
            raise QueryError(f"empty range: {raw!r}")
        return Bounds(low, high + day, high_open=True)
    op = next((o for o in COMPARISONS if o != "!=" and text.startswith(o)), "")
    at = calendar_day(text[len(op) :])
    return _compared(op or "=", at, None, Bounds(at, at + day, high_open=True))
