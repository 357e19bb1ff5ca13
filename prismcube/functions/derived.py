"""Functions of derived expressions, and the small expression language with safe division.

An expression is written over {column} references: `{revenue} /- {quantity}`, `sum({a} * {b}) /- sum({b})`.  `/-` is
safe division: 0.0 for a denominator of 0, null for null.  Plain `/` gives null for 0 instead of an error.  Functions
take columns, numbers and 'texts'; those of WRITTEN take formats, searches and the like as they are written.  <name> and
<name|default> stand for what the request says, see `with_replacements`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rollups import zero_safe


class ExpressionError(ValueError):
    """An expression can't be read."""


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*)|\{([^}]+)\}|'((?:[^']|'')*)'|(/-|[-+*/(),])|([A-Za-z_]\w*))")


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count, "count_distinct": F.count_distinct, "coalesce": F.coalesce,
    "nvl": F.coalesce, "nullif": F.nullif, "concat": F.concat, "timestamp_millis": F.timestamp_millis, "trim": F.trim, "abs": F.abs, "lower": F.lower, "upper": F.upper, "least": F.least, "greatest": F.greatest,
}
#: Native translations of an application's own functions: javascript('name', {a}, ...).
NATIVE: dict[str, Callable[..., Column]] = {}


def register_native(name: str, made: Callable[..., Column]) -> None:
    NATIVE[name] = made


AGGREGATES = {"sum", "max", "min", "avg", "count", "count_distinct"}


def references(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([^}]+)\}", text)))


def is_aggregate(text: str) -> bool:
    return any(re.search(rf"\b{a}\s*\(", text, re.I) for a in AGGREGATES)


def parse(text: str, resolve: Callable[[str], Column], *, raw: Callable[[str], Column] | None = None, aggregate: Callable[..., Column] | None = None) -> Column:
    """The Column of an expression; resolve gives the Column of a reference.

    aggregate: called as (name, *arguments) for each aggregate; raw: references inside of one.
    """
    depth = 0
    tokens, i = [], 0
    while i < len(text.rstrip()):
        m = _TOKEN.match(text, i)
        if not m:
            raise ExpressionError(f"can't read {text[i:]!r}")
        tokens.append(m)
        i = m.end()
    at = 0

    def peek() -> str | None:
        return tokens[at].group(4) if at < len(tokens) else None

    def take():
        nonlocal at
        if at >= len(tokens):
            raise ExpressionError(f"{text!r} ends too soon")
        at += 1
        return tokens[at - 1]

    def constant(m):
        number, string = m.group(1), m.group(3)
        return string.replace("''", "'") if number is None else float(number) if "." in number else int(number)

    def factor() -> Column:
        nonlocal depth
        m = take()
        number, ref, string, sign, name = m.groups()
        if number or string is not None:
            return F.lit(constant(m))
        if ref:
            return raw(ref) if raw and depth else resolve(ref)
        if sign == "-":
            return -factor()
        if sign == "(":
            out = sums()
            if take().group(4) != ")":
                raise ExpressionError(f"unclosed bracket in {text!r}")
            return out
        if name and peek() == "(":
            take()
            args, written, inside = [], {}, name.lower() in AGGREGATES
            depth += inside
            while peek() != ")":
                began = at
                args.append(sums())
                if at - began == 1 and (tokens[began].group(1) or tokens[began].group(3) is not None):
                    written[len(args) - 1] = constant(tokens[began])
                if peek() == ",":
                    take()
            take()
            depth -= inside
            if inside and aggregate:
                return aggregate(name.lower(), *args)
            if name.lower() in WRITTEN:
                try:
                    # What a function is of is a column; the rest as it is written.
                    return WRITTEN[name.lower()](*[a if k == 0 and name.lower() != "javascript" else written.get(k, a) for k, a in enumerate(args)])
                except (TypeError, KeyError) as e:
                    raise ExpressionError(f"{name} can't take its arguments in {text!r}") from e
            if name.lower() not in FUNCTIONS:
                raise ExpressionError(f"unknown function {name}")
            return FUNCTIONS[name.lower()](*args)
        raise ExpressionError(f"unexpected {m.group().strip()!r} in {text!r}")

    def products() -> Column:
        out = factor()
        while peek() in ("*", "/", "/-"):
            op = take().group(4)
            b = factor()
            out = out * b if op == "*" else _div(out, b) if op == "/" else zero_safe(out, b)
        return out

    def sums() -> Column:
        out = products()
        while peek() in ("+", "-"):
            op = take().group(4)
            b = products()
            out = out + b if op == "+" else out - b
        return out

    out = sums()
    if at < len(tokens):
        raise ExpressionError(f"{text!r} goes on after its end")
    return out


_PLACE = re.compile(r"'(?:[^']|'')*'|<(\w+)(?:\|([^<>]*))?>")
_INSIDE = re.compile(r"<(\w+)(?:\|([^<>]*))?>")


def with_replacements(text: str, context: Mapping[str, object]) -> str:
    """An expression whose <placeholders> are filled in from the request's context.  Inside of quotes any text can stand
    for one, outside only a number: what a request says never becomes more than a constant."""

    def found(m) -> str:
        value = context.get(m[1], m[2])
        if value is None:
            raise ExpressionError(f"no value for {m[1]}")
        return str(value)

    def place(m) -> str:
        if m[0][0] == "'":
            return _INSIDE.sub(lambda k: found(k).replace("'", "''"), m[0])
        value = found(m)
        if not re.fullmatch(r"-?\d+(\.\d+)?", value):
            raise ExpressionError(f"{m[1]} takes a number")
        return value

    return _PLACE.sub(place, text)


def decode(value: Column, *args) -> Column:
    """DECODE(value, search, result, ..., [default]); without a default null."""
    if len(args) < 2:
        raise ExpressionError("decode needs a value, a search and a result")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = None
    for s, r in zip(args[: len(args) // 2 * 2 : 2], args[1::2], strict=False):
        out = F.when(value == lit(s), lit(r)) if out is None else out.when(value == lit(s), lit(r))
    return out.otherwise(lit(args[-1])) if len(args) % 2 else out


def compare_percentage(chain: list[tuple[Column, Column, int, str]], otherwise) -> Column:
    """The value of the first (a, b, percentage, value) with a < percentage / 100 * b."""
    out = None
    for a, b, pct, value in chain:
        test = a < F.lit(pct) / 100 * b
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def regex_extract(c: Column, pattern: str, group: int, replace_missing: bool = False, replacement: str = "") -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(F.length(found) > 0, found).otherwise(F.lit(replacement)) if replace_missing else found


def truncate(c: Column, kind: str = "number") -> Column:
    """Toward zero; a date or time to its day."""
    return F.date_trunc("day", c) if kind == "date" else F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def interval_date(c: Column, fmt: str) -> Column:
    """d: day, w: Monday of the week, m: first of the month, day: name of the weekday, yr: year."""
    d = c.cast("date")
    made = {"d": lambda: d, "w": lambda: F.date_trunc("week", d).cast("date"), "m": lambda: F.trunc(d, "MM"), "day": lambda: F.date_format(d, "EEEE"), "yr": lambda: F.year(d).cast("string")}
    if fmt.lower() not in made:
        raise ExpressionError(f"unknown interval {fmt}")
    return made[fmt.lower()]()


def format_date(c: Column, fmt: str) -> Column:
    return F.coalesce(F.date_format(c, fmt), F.lit("NULL"))


def format_date_least(c: Column, fmt: str) -> Column:
    return format_date(F.least(c.cast("date"), F.lit("3000-01-01").cast("date")), fmt)


def millis_to_date(c: Column, fmt: str) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(c % F.lit(32503680000000)), fmt), F.lit("NULL"))


def to_char(c: Column, fmt: str) -> Column:
    return F.date_format(c, fmt)


def day_of_week(c: Column, fmt: str) -> Column:
    return F.date_format(F.to_date(c, fmt), "EEEE")


def time_format_zone(c: Column, input_format: str, output_format: str, zone: str = "UTC") -> Column:
    """Read as UTC, shown in the zone."""
    return F.date_format(F.from_utc_timestamp(F.to_timestamp(c, input_format), zone), output_format)


def video_weighted(q25: Column, q50: Column, q75: Column, q100: Column) -> Column:
    return reduce(add, (F.lit(w) * F.coalesce(c, F.lit(0)) for w, c in ((0.25, q25), (0.5, q50), (0.75, q75), (1.0, q100)))) * 100


def video_sum(*parts: Column) -> Column:
    return reduce(add, parts)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def decode_dim(c: Column, *args) -> Column:
    """As decode, but without a default the value itself stays."""
    return decode(c, *args) if len(args) % 2 else decode(c, *args, c)


def substring(c: Column, index: int, length: int) -> Column:
    """index counts from 0."""
    return F.substring(c, index + 1, length)


def interval_text(c: Column, source_format: str, out_format: str) -> Column:
    return F.date_format(F.to_date(c, source_format), out_format)


def time_format(ts: Column, fmt: str, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), fmt)


PERIODS = {"P1D": "day", "P1W": "week", "P1M": "month", "P3M": "quarter", "P1Y": "year", "PT1H": "hour", "PT1M": "minute"}


def time_format_period(ts: Column, fmt: str, period: str, zone: str = "UTC") -> Column:
    if period not in PERIODS:
        raise ExpressionError(f"unknown period {period}")
    return F.date_format(F.date_trunc(PERIODS[period], F.from_utc_timestamp(ts.cast("timestamp"), zone)), fmt)


def native(name: str, *columns) -> Column:
    """JavaScript isn't evaluated: its native translation is registered by name."""
    if name not in NATIVE:
        raise ExpressionError(f"no native translation of {name} is registered")
    return NATIVE[name](*map(_column, columns))


def iso_week(d: Column) -> Column:
    """Year and week of the ISO calendar as xxxx-w."""
    d = d.cast("date")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-"), F.weekofyear(d).cast("string"))


def week_start(c: Column) -> Column:
    """The Monday of a week xxxx-w."""
    part = lambda k: F.try_element_at(F.split(c.cast("string"), "-"), F.lit(k)).try_cast("int")
    first = F.date_trunc("week", F.make_date(part(1), F.lit(1), F.lit(4))).cast("date")  # January 4 is in week 1
    return F.date_format(F.date_add(first, (part(2) - 1) * 7), "yyyy-MM-dd")


def month_start(d: Column) -> Column:
    return F.date_format(F.trunc(d.cast("date"), "MM"), "yyyy-MM-dd")


def day_text(d: Column, source_format: str | None = None) -> Column:
    return F.date_format(F.to_date(d, source_format) if source_format else d, "yyyy-MM-dd")


def number(c: Column, scale: int = 10) -> Column:
    """Half-even to the scale."""
    return F.bround(c, scale)


def in_ranges(c: Column, *triples) -> Column:
    """low, high, value, ...: the value of the half-open range that holds c; null for none."""
    from ..operators.joins import in_ranges as found
    from ..plans.select import RangeLookup

    if not triples or len(triples) % 3:
        raise ExpressionError("in_ranges takes low, high and value of each range")
    return found(c, RangeLookup([tuple(triples[i : i + 3]) for i in range(0, len(triples), 3)]))


#: Functions that take arguments as they are written.
WRITTEN: dict[str, Callable[..., Column]] = {
    "round": F.round, "trunc": truncate, "decode": decode, "decode_dim": decode, "decode_retain": decode_dim,
    "compare_percentage": lambda a, b, pct, value, rest: compare_percentage([(a, _column(b), pct, value)], rest), "regex_extract": lambda c, p, k, rest=None: regex_extract(c, p, k, rest is not None, rest or ""),
    "get_interval_date": interval_date, "interval_text": interval_text, "format_date": format_date, "format_date_with_least": format_date_least, "timestamp_to_formatted_date": millis_to_date,
    "to_char": to_char, "day_of_week": day_of_week, "time_format_with_timezone": time_format_zone, "time_format": time_format, "time_format_period": time_format_period, "substr": substring,
    "javascript": native, "iso_week": iso_week, "start_of_the_week": week_start, "start_of_the_month": month_start, "day_text": day_text, "number": number,
    "video_weighted": lambda *a: video_weighted(*map(_column, a)), "video_sum": lambda *a: video_sum(*map(_column, a)), "in_ranges": in_ranges,
}
