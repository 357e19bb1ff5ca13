"""Analyses on top of a request: period over period, grand totals, row counts and drill-down.

Each curator makes further requests of the same cube and combines DataFrames; nothing is collected.  They run by level
and priority, and later ones can use earlier results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce
from operator import and_
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import IntType
from .operators.filters import Filter
from .request import Field, Request, RequestError, SortBy, day_range
from .request import from_json as request_from_json
from .plans.lower import TOTAL

if TYPE_CHECKING:
    from .engine import Engine

#: Rows that a fact-driven row count without an exact count is estimated to have at most.
ROW_ESTIMATE = 5000


@dataclass
class Curator:
    name: str
    run: Callable[[Engine, Request, dict[str, Any], dict[str, DataFrame]], DataFrame]
    level: int = 1
    priority: int = 0
    needs_default: bool = False
    singleton: bool = False
    injects: Callable[[Request], tuple[str, ...]] = lambda request: ()
    validators: list[Callable[[Request, dict[str, Any]], None]] = field(default_factory=list)


def default(engine: Engine, request: Request, config: dict, done: dict) -> DataFrame:
    return engine.frame(request)


def previous_window(request: Request, days_offset: int = 0) -> Filter:
    """The window of the same length that ends a day before, `days_offset` days earlier."""
    first, last = day_range(request.day)
    offset, days = 1 + days_offset, (last - first).days
    return Filter("Between", "Day", ((first - timedelta(days + offset)).isoformat(), (first - timedelta(offset)).isoformat()))


def time_shift(engine: Engine, request: Request, config: dict, done: dict) -> DataFrame:
    """Each metric with its value in the window before and the change in percent, most change first."""
    now = engine.resolve(request)
    if request.day.op not in ("Between", "=", "In"):
        raise RequestError("a time shift needs days")
    metrics = [i.name for i in now.items if i.kind == "metric"]
    keys = [i.name for i in now.items if i.kind in ("fact_dim", "dim")]
    if not metrics or not keys:
        raise RequestError("a time shift needs a dimension and a metric")
    current = done["default"] if "default" in done else engine.frame(request)
    before = engine.frame(request.with_(day=previous_window(request, int(config.get("daysOffset", 0))), start=0, rows=-1, sort=(), row_count=False))
    before = before.select(*[F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)], *[F.col(f"`{m}`").alias(f"_m{n}") for n, m in enumerate(metrics)])
    both = current.join(before, reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys))), "left")
    shown = [F.col(f"`{c}`") for c in current.columns]
    for n, m in enumerate(metrics):
        prev, cur = F.coalesce(F.col(f"_m{n}").cast("double"), F.lit(0.0)), F.coalesce(F.col(f"`{m}`").cast("double"), F.lit(0.0))
        kind = now.fact.column(next(i.column for i in now.items if i.name == m)).type
        shown.append((prev.cast("bigint") if isinstance(kind, IntType) else prev).alias(f"{m} Prev"))
        change = F.when(cur - prev == 0, 0.0).when(prev == 0, 100.0).otherwise(F.round(F.try_divide(cur - prev, prev) * 100, 2))
        shown.append(change.alias(f"{m} Pct Change"))
    by = next((s for s in request.sort if s.field in metrics), None)
    name = f"{by.field if by else metrics[0]} Pct Change"
    order = F.col(f"`{name}`").asc_nulls_last() if by and not by.descending else F.col(f"`{name}`").desc_nulls_last()
    return both.select(*shown).orderBy(order, *[F.col(f"`{k}`").asc_nulls_last() for k in keys])


def total_metrics(engine: Engine, request: Request, config: dict, done: dict) -> DataFrame:
    """One row: the metrics over all that the filters leave."""
    r = engine.resolve(request)
    metrics = tuple(Field(f.field, f.alias) for f, i in zip(request.fields, r.items, strict=True) if i.kind == "metric")
    if not metrics:
        raise RequestError("there is no metric to total")
    return engine.frame(request.with_(fields=metrics, sort=(), start=0, rows=-1, row_count=False, dimension_driven=False, fact_driven=True, revision=config.get("forceRevision", request.revision)))


def row_count(engine: Engine, request: Request, config: dict, done: dict) -> DataFrame:
    """TOTALROWS: exact for dimensions and with isFactDriven; else a bounded estimate from the dimensions' cardinality."""
    r = engine.resolve(request)
    if r.dimension_driven:
        key = engine.registry.dims[r.driving].key_alias
        bare = request.with_(fields=(Field(key, key),), sort=(), start=0, rows=-1, row_count=False)
        return engine.frame(bare).agg(F.count(F.lit(1)).alias(TOTAL))
    if config.get("isFactDriven"):
        return engine.planner.groups(r)
    estimate = config.get("cardinality") or r.fact.default_cardinality
    if not estimate:
        raise RequestError("the number of rows can't be estimated")
    return engine.spark.range(1).select(F.lit(min(int(estimate), ROW_ESTIMATE)).cast("bigint").alias(TOTAL))


def drill_down(engine: Engine, request: Request, config: dict, done: dict) -> DataFrame:
    """A finer breakdown of what the default page shows: its most detailed key restricts the new request."""
    dims = config.get("dimension") or config.get("dimensions")
    if not dims:
        raise RequestError("a drill-down needs a dimension")
    dims = [dims] if isinstance(dims, str) else list(dims)
    r = engine.resolve(request)
    keys = [i for i in r.items if (i.kind == "fact_dim" and i.column in r.fact.foreign_keys.values()) or (i.kind == "dim" and i.column == engine.registry.dims[i.dim].table.key)]
    if not keys:
        raise RequestError("a drill-down needs a key among the fields")
    level = lambda i: engine.registry.dims[i.dim or next(d for d, c in r.fact.foreign_keys.items() if c == i.column)].table.level
    key = max(keys, key=level)
    of = {i.name: f.field for i, f in zip(r.items, request.fields, strict=True)}
    metrics = [Field(of[i.name], i.name) for i in r.items if i.kind == "metric"]
    metrics += [Field(x, x) for x in config.get("facts", []) if x not in {m.field for m in metrics}] if config.get("additiveFacts", True) else []
    fields = [*(Field(d, d) for d in dims), Field(of[key.name], key.name), *metrics]
    cube = config.get("cube", request.cube)
    filters = request.filters
    if config.get("enforceFilters"):
        facts = {c.alias for c in (*r.cube.dims, *r.cube.metrics)}
        filters = tuple(f for f in filters if f.fields() <= facts)
    sort = tuple(SortBy(x["field"], str(x.get("order", "ASC")).upper() == "DESC") for x in config.get("ordering", [])) or tuple(s for s in request.sort if s.field in {f.alias for f in fields})
    finer = request.with_(cube=cube, fields=tuple(fields), filters=filters, sort=sort, start=0, rows=int(config.get("mr", 1000)), fact_driven=True, dimension_driven=False, row_count=False)
    page = done["default"].select(F.col(f"`{key.name}`")).distinct()
    to = engine.resolve(finer)
    column = key.column if key.kind == "fact_dim" else to.fact.foreign_keys.get(key.dim)
    if column is None:
        raise RequestError(f"{cube} has no key of {key.dim}")
    return engine.frame(finer, only_keys=[(column, page)])


CURATORS = {
    c.name: c
    for c in (
        # A page with a row count brings the count of all rows along, but where dimensions drive: there it is in the page.
        Curator("default", default, 0, injects=lambda request: ("rowcount",) if request.row_count and not request.dimension_driven else ()),
        Curator("timeshift", time_shift, 1, singleton=True),
        Curator("totalmetrics", total_metrics, 1, 1),
        Curator("rowcount", row_count, 1, 2),
        Curator("drilldown", drill_down, 10, needs_default=True),
    )
}


def coordinate(engine: Engine, request: Request | dict | str, curators: dict[str, Curator] | None = None) -> dict[str, DataFrame]:
    """The result of each curator that the request names; the default one always, unless a singleton stands alone."""
    request = request if isinstance(request, Request) else request_from_json(request)
    known = curators or CURATORS
    asked = dict(request.curators) or {"default": {}}
    for name in list(asked):
        if name not in known:
            raise RequestError(f"there is no curator {name}")
    for name in asked:
        if known[name].singleton and len([n for n in asked if n != "default"]) > 1:
            raise RequestError(f"{name} can't be combined with other curators")
    if not any(known[n].singleton for n in asked):
        asked.setdefault("default", {})
        for name in list(asked):  # what was asked for itself keeps its own configuration
            for extra in known[name].injects(request):
                asked.setdefault(extra, {})
    done: dict[str, DataFrame] = {}
    for name in sorted(asked, key=lambda n: (known[n].level, known[n].priority)):
        c = known[name]
        for check in c.validators:
            check(request, asked[name])
        if c.needs_default and "default" not in done:
            raise RequestError(f"{name} needs the default result")
        done[name] = c.run(engine, request, asked[name], done)
    return done
