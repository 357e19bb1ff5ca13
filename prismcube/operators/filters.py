"""Filters of a request: parsing, checks, and predicates as Columns.

Differences chosen on purpose: `Like` means contains, and the value is compared literally; a negated filter drops
nulls, as SQL does; an `Or` has to be of one kind (metrics, or dimensions) or is refused, as an or can't be split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ColumnType, DateType, DimCol, IntType, StrType, TimestampType


class FilterError(ValueError):
    """A filter that can't be used."""


#: Spellings in requests -> operation.
NAMES = {
    "in": "In", "not in": "Not In", "between": "Between", "datetimebetween": "DateTimeBetween", "=": "=", "equals": "=", "equal": "=",
    "==": "==", ">": ">", "<": "<", "like": "Like", "not like": "Not Like", "<>": "<>", "not equal to": "<>", "isnull": "IsNull",
    "is null": "IsNull", "isnotnull": "IsNotNull", "is not null": "IsNotNull", "or": "Or", "and": "And", "outer": "Outer",
    "javascript": "JavaScript",
}


@dataclass(frozen=True)
class Filter:
    op: str
    field: str = ""
    values: tuple = ()
    compare_to: str | None = None
    children: tuple[Filter, ...] = ()
    format: str | None = None
    forced: bool = False
    overridable: bool = False
    push_down: bool = False
    fn: Callable[[Column], Column] | None = None  # for JavaScript: the native translation of the function

    def fields(self) -> set[str]:
        if self.children:
            return set().union(*(c.fields() for c in self.children))
        return {self.field} | ({self.compare_to} if self.compare_to else set())

    def renamed(self, name: str, compare_to: str | None = None) -> Filter:
        from dataclasses import replace

        return replace(self, field=name, compare_to=compare_to or self.compare_to)


def F_in(field: str, *values, **k) -> Filter:
    return Filter("In", field, tuple(values), **k)


def F_not_in(field: str, *values, **k) -> Filter:
    return Filter("Not In", field, tuple(values), **k)


def F_between(field: str, lo, hi, **k) -> Filter:
    return Filter("Between", field, (lo, hi), **k)


def F_eq(field: str, value, **k) -> Filter:
    return Filter("=", field, (value,), **k)


def pushed(f: Filter) -> Filter:
    """A key filter that is copied onto each table of a join; Catalyst would infer it from the join's equality too."""
    from dataclasses import replace

    return replace(f, push_down=True)


def parse(obj: dict[str, Any]) -> Filter:
    """From a request's JSON.  Force and override flags are never taken from there."""
    if "operator" not in obj:
        raise FilterError(f"operator missing in {obj}")
    op = NAMES.get(str(obj["operator"]).strip().lower())
    if op is None:
        raise FilterError(f"unknown operator {obj['operator']}")
    if op in ("Or", "And", "Outer"):
        inner = obj.get("outerFilters" if op == "Outer" else "filterExpressions") or obj.get("filterExpressions") or []
        if not inner:
            raise FilterError(f"{op} has no filters")
        return Filter(op, children=tuple(parse(x) for x in inner))
    name = obj.get("field")
    if not name:
        raise FilterError(f"field missing in {obj}")
    if op in ("In", "Not In"):
        values = obj.get("values")
        if not isinstance(values, list) or not values:
            raise FilterError(f"{op} on {name} needs values")
        if any(str(v) == "" for v in values):
            raise FilterError(f"{op} on {name} has an empty value")
        return Filter(op, name, tuple(values))
    if op in ("Between", "DateTimeBetween"):
        if "from" not in obj or "to" not in obj:
            raise FilterError(f"{op} on {name} needs from and to")
        return Filter(op, name, (obj["from"], obj["to"]), format=obj.get("format"))
    if op == "==":
        if not obj.get("compareTo"):
            raise FilterError(f"== on {name} needs compareTo")
        return Filter(op, name, compare_to=obj["compareTo"])
    if op in ("IsNull", "IsNotNull"):
        return Filter(op, name)
    if op == "JavaScript":
        raise FilterError("JavaScript filters aren't evaluated; declare a Filter with fn")
    value = obj.get("value", (obj.get("values") or [None])[0])
    if value is None or str(value) == "":
        raise FilterError(f"{op} on {name} needs a value")
    return Filter(op, name, (value,))


def rewrite_labels(f: Filter, type_: ColumnType) -> Filter:
    """A filter on labels of a static mapping, as one on codes; one label can stand for many codes."""
    if not getattr(type_, "mapping", None) or f.op in ("IsNull", "IsNotNull"):
        return f
    ops = {"=": "In", "In": "In", "<>": "Not In", "Not In": "Not In"}
    if f.op not in ops:
        raise FilterError(f"{f.op} can't be used on {f.field}, which has labels")
    codes: list = []
    for v in f.values:
        found = [code for code, label in type_.mapping.items() if str(label) == str(v)]
        if not found:
            raise FilterError(f"{f.field} has no label {v}")
        codes += found
    from dataclasses import replace

    return replace(f, op=ops[f.op], values=tuple(codes))


def check_length(f: Filter, type_: ColumnType) -> None:
    if isinstance(type_, StrType) and type_.length and not type_.mapping:
        for v in f.values:
            if len(str(v)) > type_.length:
                raise FilterError(f"value of {f.field} is longer than {type_.length}")


def _literal(value: Any, type_: ColumnType) -> Column:
    if isinstance(type_, IntType):
        return F.lit(int(value))
    if isinstance(type_, DateType):
        return F.lit(str(value)).cast("date") if not type_.format else F.to_date(F.lit(str(value)), type_.format)
    if isinstance(type_, TimestampType):
        return F.lit(str(value)).cast("timestamp_ntz")
    if type_.spark == "double":
        return F.lit(float(value))
    if type_.spark == "string":
        return F.lit(str(value))
    return F.lit(value)


def day_bounds(column: Column, lo: str, hi: str, day_format: str | None, is_timestamp: bool) -> Column:
    """Inclusive days.  Stored as int or string: formatted bounds; a timestamp: up to the start of the day after."""
    if day_format:
        cast = "int" if set(day_format) <= set("yMdH") else "string"
        bound = lambda v: F.date_format(F.lit(v).cast("date"), day_format).cast(cast)
        return (column >= bound(lo)) & (column <= bound(hi))
    if is_timestamp:
        return (column >= F.lit(lo).cast("timestamp_ntz")) & (column < F.date_add(F.lit(hi).cast("date"), 1).cast("timestamp_ntz"))
    return column.between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))


def expanded_days(column: Column, lo: str, hi: str, day_format: str) -> Column:
    """Each formatted day of a range, as an In; equal to the range."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(lo), date.fromisoformat(hi)
    days = [F.date_format(F.lit(str(a + timedelta(d))).cast("date"), day_format) for d in range((b - a).days + 1)]
    return column.isin(days)


def predicate(f: Filter, column: Column, type_: ColumnType, *, case_insensitive: bool = False, day_format: str | None = None, is_day: bool = False, other: Column | None = None) -> Column:
    """The filter as a Column over `column`."""
    low = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    c = low(column)
    lits = lambda: [low(_literal(v, type_)) for v in f.values]
    op = f.op
    if op == "In":
        return c.isin(lits())
    if op == "Not In":
        return ~c.isin(lits())
    if op == "=":
        if is_day:
            return day_bounds(column, str(f.values[0]), str(f.values[0]), day_format, isinstance(type_, TimestampType))
        return c == lits()[0]
    if op == "<>":
        return c != lits()[0]
    if op in (">", "<"):
        return column > _literal(f.values[0], type_) if op == ">" else column < _literal(f.values[0], type_)
    if op == "Between":
        if is_day:
            return day_bounds(column, str(f.values[0]), str(f.values[1]), day_format, isinstance(type_, TimestampType))
        lo, hi = (_literal(v, type_) for v in f.values)
        return column.between(lo, hi)
    if op == "DateTimeBetween":
        lo, hi = (F.to_timestamp_ntz(F.lit(str(v)), F.lit(f.format)) if f.format else F.lit(str(v)).cast("timestamp_ntz") for v in f.values)
        return column.between(lo, hi)
    if op == "Like":
        return c.contains(low(F.lit(str(f.values[0]))))
    if op == "Not Like":
        return ~c.contains(low(F.lit(str(f.values[0]))))
    if op == "IsNull":
        return column.isNull()
    if op == "IsNotNull":
        return column.isNotNull()
    if op == "==":
        return column == other
    if op == "JavaScript":
        if f.fn is None:
            raise FilterError("JavaScript isn't evaluated; give the native translation as fn")
        return f.fn(column)
    raise FilterError(f"{op} has no predicate of its own")


def combined(f: Filter, leaf: Callable[[Filter], Column]) -> Column:
    """And, Or and Outer as trees over the leaves' predicates."""
    if f.op in ("Or", "And", "Outer"):
        return reduce(or_ if f.op == "Or" else and_, (combined(c, leaf) for c in f.children))
    return leaf(f)


def all_of(conditions: Iterable[Column]) -> Column | None:
    conditions = list(conditions)
    return reduce(and_, conditions) if conditions else None


def with_forced(user: list[Filter], forced: Iterable[Filter]) -> list[Filter]:
    """Forced filters are added unless the user filters the same field and may; repeated ones are left out."""
    from dataclasses import replace

    fields = set().union(*(f.fields() for f in user)) if user else set()
    out = list(user)
    for f in forced:
        if f.overridable and f.fields() & fields:
            continue
        f = replace(f, forced=True)
        if not any(replace(x, forced=True) == f for x in out):
            out.append(f)
    return out


def column_predicate(f: Filter, col: DimCol, column: Column, *, is_day: bool = False, other: Column | None = None) -> Column:
    check_length(f, col.type)
    return predicate(rewrite_labels(f, col.type), column, col.type, case_insensitive=col.case_insensitive, day_format=col.day_format, is_day=is_day, other=other)


