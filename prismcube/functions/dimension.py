"""Extraction functions of dimensions and functions on the rows of a result, as Python callables over columns.

The expression language has each of them by name (`derived.WRITTEN`); these are for columns that are declared by a
function instead of a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .derived import ExpressionError, day_text, decode, decode_dim, interval_text, iso_week, month_start, number, regex_extract, substring, time_format, time_format_period, week_start

__all__ = ["day_text", "decode_dim", "interval_date", "iso_week", "javascript", "month_start", "number", "post_decode", "regex", "substring", "time_format", "time_format_context", "time_format_period", "week_start", "weekday"]

regex, interval_date = regex_extract, interval_text


def weekday(c: Column, source_format: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.to_date(c, source_format), "EEEE")


def time_format_context(ts: Column, fmt: str, context: dict) -> Column:
    """The zone comes from the request."""
    return time_format(ts, fmt, context.get("TimeZone", "UTC"))


def javascript(*columns: Column, fn=None) -> Column:
    """JavaScript isn't evaluated: fn is its native translation over the columns."""
    if fn is None:
        raise ExpressionError("give the native translation of the function as fn")
    return fn(*columns)


def post_decode(value: Column, mapping: dict, default: Column | None = None) -> Column:
    """A literal or another column for each value."""
    args = [x for k, v in mapping.items() for x in (k, v)]
    return decode(value, *args, value if default is None else default)
