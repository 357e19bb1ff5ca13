"""Time windows of a request in UTC, as half-open or closed bounds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .request import Request, RequestError, moment

STEP = {"daily": timedelta(days=1), "hourly": timedelta(hours=1), "minute": timedelta(minutes=1)}


@dataclass(frozen=True)
class Window:
    """[start, end) in UTC."""

    start: datetime
    end: datetime


def to_utc(local: datetime, zone: str | None) -> datetime:
    return local.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC).replace(tzinfo=None) if zone else local


def _number(v) -> int:
    try:
        return int(str(v))
    except ValueError as e:
        raise RequestError(f"{v} is no hour or minute") from e


def windows(request: Request, zone: str | None = None) -> list[Window]:
    """The request's windows; local bounds are shifted to UTC exactly.

    Between takes all from the first day, hour and minute up to the last, inclusive.  For = and In each day is a window,
    or each hour and minute of it that is asked for.
    """
    day, hour, minute = request.day, request.hour, request.minute
    if day.op == "DateTimeBetween":
        lo, hi = (moment(v, day.format) for v in day.values)
        return [Window(to_utc(lo, zone), to_utc(hi, zone) + timedelta(microseconds=1))]
    unit = timedelta(minutes=1) if minute else timedelta(hours=1) if hour else timedelta(days=1)
    at = lambda d, h, m: datetime.combine(date.fromisoformat(str(d)[:10]), time(_number(h), _number(m)))
    if day.op == "Between":
        h = hour.values if hour else (0, 0)
        m = minute.values if minute else (0, 0)
        lo, hi = at(day.values[0], h[0], m[0]), at(day.values[1], h[1], m[1])
        return [Window(to_utc(lo, zone), to_utc(hi + unit, zone))]
    out = []
    for d in day.values:
        for h in hour.values if hour else (0,):
            for m in minute.values if minute else (0,):
                lo = at(d, h, m)
                out.append(Window(to_utc(lo, zone), to_utc(lo + unit, zone)))
    return out


def widened(lo: date, hi: date) -> tuple[date, date]:
    """Of days in an unknown zone: a day more at either side."""
    return lo - timedelta(1), hi + timedelta(1)


def hours_to_utc(lo: date, hi: date, h0: int, h1: int, zone: str) -> tuple[date, date, int, int]:
    """Days and hours of a local window in UTC; the days shift where hours cross midnight."""
    a, b = to_utc(datetime.combine(lo, time(h0)), zone), to_utc(datetime.combine(hi, time(h1)), zone)
    return a.date(), b.date(), a.hour, b.hour


def within(column: Column, spans: list[Window], kind: str = "timestamp") -> Column:
    """Predicate over a physical time column; literals only, so that it reaches the scan."""
    cast = {"timestamp": "timestamp_ntz", "date": "date"}[kind]
    out = None
    for w in spans:
        end = w.end if kind == "timestamp" else datetime.combine((w.end - timedelta(microseconds=1)).date() + timedelta(1), time())
        one = (column >= F.lit(w.start.isoformat(sep=" ")).cast("timestamp_ntz").cast(cast)) & (column < F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz").cast(cast))
        out = one if out is None else out | one
    return out
