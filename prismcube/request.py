"""The reporting request: what a user asks of a cube, read from JSON and checked for form."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta
from typing import Any

from .operators.filters import Filter, parse


class RequestError(ValueError):
    """A request that can't be answered."""


DEFAULT_ROWS = 200
QUERY_TYPES = ("groupby", "scan", "rowcount", "select")


@dataclass(frozen=True)
class Field:
    field: str
    alias: str
    value: Any = None  # a constant column
    lookup: Mapping[str, Any] | None = None  # arguments of a `model.Lookup` whose key is the field


@dataclass(frozen=True)
class SortBy:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Request:
    cube: str
    fields: tuple[Field, ...]
    filters: tuple[Filter, ...] = ()
    day: Filter | None = None
    hour: Filter | None = None
    minute: Filter | None = None
    sort: tuple[SortBy, ...] = ()
    start: int = 0
    rows: int = DEFAULT_ROWS  # 0 or less: all
    dimension_driven: bool = False
    fact_driven: bool = False
    row_count: bool = False
    query_type: str = "groupby"
    parameters: Mapping[str, Any] = field(default_factory=dict)
    curators: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    revision: int | None = None

    @property
    def is_async(self) -> bool:
        return str(self.parameters.get("RequestType", "sync")).lower() == "async"

    def with_(self, **changes) -> Request:
        return replace(self, **changes)


#: Letters of date patterns in requests and what they are in Python's.
PATTERNS = (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("SSS", "%f"), ("ss", "%S"), ("'T'", "T"))


def moment(value: Any, form: str | None = None) -> datetime:
    """A day or time of a request; form: its pattern, where it isn't ISO."""
    text = str(value)
    try:
        if not form:
            return datetime.fromisoformat(text)
        for letters, own in PATTERNS:
            form = form.replace(letters, own)
        return datetime.strptime(text, form)
    except ValueError as e:
        raise RequestError(f"{text} is no day or time of the form {form or 'yyyy-MM-dd'}") from e


def day_range(f: Filter) -> tuple[date, date]:
    """First and last day of a Day filter."""
    days = [moment(v, f.format).date() for v in f.values]
    if f.op in ("Between", "DateTimeBetween") and days[0] > days[1]:
        raise RequestError(f"the day {f.values[0]} is after {f.values[1]}")
    return min(days), max(days)


def _lookup(x: Mapping[str, Any]) -> dict[str, Any]:
    """{"namespace", "column"[, "missing"][, "retain"][, "values"][, "keys"]}."""
    if unknown := set(x) - {"namespace", "column", "missing", "retain", "values", "keys"}:
        raise RequestError(f"a lookup has no {', '.join(sorted(unknown))}")
    if not x.get("namespace") or not x.get("column"):
        raise RequestError("a lookup needs a namespace and a column")
    pairs = {k: tuple(dict(x[k]).items()) for k in ("values", "keys") if x.get(k)}
    return {"namespace": x["namespace"], "value": x["column"], "missing": x.get("missing"), "retain": bool(x.get("retain")), **pairs}


def from_json(body: str | Mapping[str, Any], *, default_day: bool = False) -> Request:
    """default_day: without a Day filter, the day 2000-01-01 is meant, for cubes that don't have days."""
    obj = json.loads(body) if isinstance(body, str) else dict(body)
    if not obj.get("cube"):
        raise RequestError("cube missing")
    raw = obj.get("selectFields") or []
    if not raw:
        raise RequestError("selectFields missing")
    fields = []
    for x in raw:
        if not x.get("field"):
            raise RequestError(f"field missing in {x}")
        fields.append(Field(x["field"], x.get("alias") or x["field"], x.get("value"), _lookup(x["lookup"]) if x.get("lookup") else None))
    names = [f.alias for f in fields]
    if len(set(names)) < len(names):
        raise RequestError("two fields have one alias")
    times: dict[str, Filter] = {}
    filters = []
    for x in obj.get("filterExpressions") or []:
        f = parse(x)
        if f.field in ("Day", "Hour", "Minute"):
            if f.field in times:
                raise RequestError(f"{f.field} is filtered twice")
            times[f.field] = f
        else:
            filters.append(f)
    if "Day" not in times and default_day:
        times["Day"] = Filter("=", "Day", ("2000-01-01",))
    if "Day" not in times:
        raise RequestError("a Day filter is needed")
    if times["Day"].op not in ("=", "In", "Between", "DateTimeBetween"):
        raise RequestError(f"Day can't be filtered by {times['Day'].op}")
    day_range(times["Day"])
    for unit in ("Hour", "Minute"):
        if unit in times and times["Day"].op == "DateTimeBetween":
            raise RequestError(f"{unit} can't be filtered beside DateTimeBetween")
        if unit in times and times[unit].op != times["Day"].op:
            raise RequestError(f"{unit} has another operator than Day")
    sort = tuple(SortBy(x["field"], str(x.get("order", "ASC")).upper() == "DESC") for x in obj.get("sortBy") or [])
    if obj.get("forceDimensionDriven") and obj.get("forceFactDriven"):
        raise RequestError("a request can't be driven by facts and by dimensions")
    kind = str(obj.get("queryType", "groupby")).lower()
    if kind not in QUERY_TYPES:
        raise RequestError(f"unknown queryType {kind}")
    start = int(obj.get("paginationStartIndex", 0))
    if start < 0:
        raise RequestError("paginationStartIndex is below 0")
    curators = {str(k).lower(): dict((v or {}).get("config") or {}) for k, v in (obj.get("curators") or {}).items()}
    return Request(
        obj["cube"].lower(), tuple(fields), tuple(filters), times["Day"], times.get("Hour"), times.get("Minute"), sort, start, int(obj.get("rowsPerPage", DEFAULT_ROWS)),
        bool(obj.get("forceDimensionDriven")), bool(obj.get("forceFactDriven")), bool(obj.get("includeRowCount")), kind, dict(obj.get("additionalParameters") or {}), curators, obj.get("revision"),
    )


def shifted(f: Filter, days: int) -> Filter:
    """A Day filter some days earlier or later."""
    move = lambda v: (date.fromisoformat(str(v)[:10]) + timedelta(days)).isoformat() + str(v)[10:]
    return replace(f, values=tuple(move(v) for v in f.values))
