"""Checks a request against its cube, and sorts out what it asks of the fact, of dimensions and of the result."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from ..model import Cube, DimCol, FactCol, FactTable, Lookup, PublicCol, PublicDim, Registry, bound
from ..operators.filters import Filter, check_length, with_forced
from ..request import Request, RequestError, day_range
from .select import Candidate, Preference, best, candidates


@dataclass(frozen=True)
class Item:
    """A column of the result."""

    name: str
    kind: str  # fact_dim, metric, dim or const
    column: str = ""
    dim: str = ""
    value: Any = None


@dataclass(frozen=True)
class Step:
    """A dimension that is joined, by the key in `via` (another dimension, or '' for the fact)."""

    dim: str
    via: str


@dataclass
class Resolved:
    request: Request
    registry: Registry
    cube: Cube
    fact: FactTable | None
    choice: list[Candidate]
    items: list[Item]
    fact_filters: list[Filter] = field(default_factory=list)  # over columns of the fact
    dim_filters: dict[str, list[Filter]] = field(default_factory=dict)  # over columns of the dimension
    having: list[Filter] = field(default_factory=list)  # over metrics
    outer: list[Filter] = field(default_factory=list)  # over columns of the result
    steps: list[Step] = field(default_factory=list)
    semi: list[str] = field(default_factory=list)  # dimensions that only filter the fact's keys
    sort: list[tuple[str, bool]] = field(default_factory=list)
    dimension_driven: bool = False
    driving: str = ""
    join: str = "left"  # of the fact with its dimensions
    lookups: dict[str, DimCol] = field(default_factory=dict)  # columns that the request itself looks up
    high_cardinality: bool = False  # a filter names so many keys that engines rank otherwise

    @property
    def looking(self) -> tuple[list[DimCol], list[Filter]]:
        """Columns of the fact that are looked up, and the filters that wait for them."""
        from .lower import Planner

        if self.fact is None:
            return [], []
        asked = {i.column for i in self.items if i.kind == "fact_dim"}
        later = [f for f in self.fact_filters if Planner.looking(self.fact, f.fields())]
        return Planner.looking(self.fact, asked | {n for f in later for n in f.fields()}), later


def _allowed(col: PublicCol, schema: str, f: Filter | None = None) -> None:
    if col.restricted_to and schema not in col.restricted_to:
        raise RequestError(f"{col.alias} isn't for schema {schema}")
    if f is not None:
        if not col.filterable or f.op not in col.ops:
            raise RequestError(f"{f.op} isn't allowed on {col.alias}")


def _reach(registry: Registry, cube: Cube, steps: list[Step], target: str, keys: set[str]) -> list[Step] | None:
    """The steps to a dimension: from those that are joined already, or else from the fact's keys."""
    joined = {s.dim for s in steps}
    if target in joined:
        return []
    if joined and (path := registry.path(set(joined), target)):
        return [Step(d, via) for d, via in path if d not in joined]
    if path := registry.path(set(keys), target):
        return [Step(d, via) for d, via in path if d not in joined]
    return None


def resolve(registry: Registry, request: Request, *, schema: str = "default", today: date | None = None, preference: Preference | None = None, estimate=None) -> Resolved:
    today = today or date.today()
    cube = registry.cube(request.cube, request.revision)
    if cube is None:
        raise RequestError(f"there is no cube {request.cube}")
    first, last = day_range(request.day)
    grain = "minute" if request.minute else "hourly" if request.hour else "daily"
    _time_guards(cube, request, first, last, grain, today)
    keys = set().union(*(f.foreign_keys for f in cube.facts))

    def owner(alias: str) -> tuple[str, str, PublicCol, PublicDim | None]:
        """(kind, column, public column, dimension)."""
        if col := cube.public(alias):
            _allowed(col, schema)
            return ("metric" if cube.is_metric(alias) else "fact_dim"), col.column, col, None
        for d in registry.dim_of_alias(alias):
            if registry.path(keys, d.name):
                col = d.public(alias)
                _allowed(col, schema)
                return "dim", col.column, col, d
        raise RequestError(f"cube {cube.name} has no field {alias}")

    items, asked, called = [], {f.field for f in request.fields}, {}
    for f in request.fields:
        if f.value is not None:
            items.append(Item(f.alias, "const", value=f.value))
            continue
        if f.lookup is not None:
            kind, column, _, _ = owner(f.field)
            if kind != "fact_dim":
                raise RequestError(f"{f.field} can't be looked up: it is no dimension of cube {cube.name} itself")
            name = f"look {f.alias}"
            called[name] = DimCol(name, lookup=Lookup(key=column, **f.lookup), uses=(column,))
            items.append(Item(f.alias, "fact_dim", name))
            continue
        kind, column, col, d = owner(f.field)
        for other in col.depends_on:
            if other not in asked and not any(x.fields() & {other} for x in request.filters):
                raise RequestError(f"{f.field} can't be asked for without {other}")
        for other in col.incompatible:
            if other in asked:
                raise RequestError(f"{f.field} and {other} can't be asked for together")
        items.append(Item(f.alias, kind, column, d.name if d else ""))
    for col in (*cube.dims, *cube.metrics):
        if col.required and col.alias not in asked and not any(col.alias in x.fields() for x in request.filters):
            raise RequestError(f"{col.alias} is required")
    for alias in cube.schema_required.get(schema, ()):
        if not any(alias in x.fields() and x.op in ("=", "In", "==") for x in request.filters):
            raise RequestError(f"schema {schema} needs a filter on {alias}")

    r = Resolved(request, registry, cube, None, [], items, lookups=called)
    own_dim_filter = False
    # A filter of the whole user replaces forced ones on its field.
    for f in with_forced(list(request.filters), cube.forced_filters):
        if f.op == "Outer":
            for x in f.fields():
                if x not in {i.name for i in items}:
                    raise RequestError(f"{x} is in an outer filter and isn't selected")
            r.outer.append(f)
            continue
        kinds = set()
        for name in f.fields():
            kind, _, col, d = owner(name)
            kinds.add((kind, d.name if d else ""))
        if len(kinds) > 1:
            raise RequestError(f"a filter can't mix fields of different kinds: {', '.join(sorted(f.fields()))}")
        (kind, d), = kinds
        f = _on_columns(f, lambda name: owner(name)[2], schema, not f.forced)
        if kind == "metric":
            r.having.append(f)
        elif kind == "fact_dim":
            r.fact_filters.append(f)
        else:
            r.dim_filters.setdefault(d, []).append(f)
            own_dim_filter |= not f.forced and f.fields() != {registry.dims[d].table.key}
    # What is joined, the most detailed first.
    shown = {i.dim for i in items if i.dim}
    wanted = sorted(shown | set(r.dim_filters), key=lambda d: (-registry.dims[d].table.level, d))
    facts_asked = any(i.kind in ("fact_dim", "metric") for i in items) or bool(r.having or r.fact_filters)
    r.dimension_driven = request.dimension_driven or not (facts_asked or request.fact_driven)
    if r.dimension_driven and not wanted:
        raise RequestError("no dimension drives this request")
    if r.dimension_driven:
        r.driving = wanted[0]
        r.steps = [Step(r.driving, "")]
        for d in wanted[1:]:
            path = _reach(registry, cube, r.steps, d, set())
            if path is None:
                raise RequestError(f"{d} can't be reached from {r.driving}")
            r.steps += path
        r.join = "inner" if r.having else "right"
    else:
        for d in wanted:
            needed = shown | {s.via for s in r.steps}
            if d not in shown and d not in needed and d in keys and not any(registry.path({d}, s) for s in shown):
                r.semi.append(d)
                continue
            path = _reach(registry, cube, r.steps, d, keys)
            if path is None:
                raise RequestError(f"{d} can't be reached from cube {cube.name}")
            r.steps += path
        r.join = "inner" if own_dim_filter or any(d.schema_required.get(schema) for d in (registry.dims[s.dim].table for s in r.steps)) else "left"
    _choose(r, schema, grain, first, last, today, preference, estimate, facts_asked)
    names = {i.name: i for i in items}
    for s in request.sort:
        if s.field not in names:
            raise RequestError(f"{s.field} is sorted by and isn't selected")
        if names[s.field].kind != "const":
            r.sort.append((s.field, s.descending))
    if not r.sort and r.dimension_driven:
        key = registry.dims[r.driving].table.key
        r.sort = [(i.name, False) for i in items if i.dim == r.driving and i.column == key][:1]
    return r


def _time_guards(cube: Cube, request: Request, first: date, last: date, grain: str, today: date) -> None:
    if first > today:
        raise RequestError(f"{first} is in the future")
    kind = "async" if request.is_async else "sync"
    window = cube.max_window.get((kind, grain))
    if window is not None and (last - first).days > window:
        raise RequestError(f"{(last - first).days} days are more than the {window} allowed")
    back = cube.max_lookback.get((kind, grain))
    if back is not None and (today - first).days > back:
        raise RequestError(f"{first} is more than {back} days ago")


def _on_columns(f: Filter, public, schema: str, check: bool) -> Filter:
    """The filter with columns instead of aliases."""
    from dataclasses import replace

    if f.children:
        return replace(f, children=tuple(_on_columns(c, public, schema, check) for c in f.children))
    col = public(f.field)
    if check:
        _allowed(col, schema, f)
    other = public(f.compare_to) if f.compare_to else None
    return f.renamed(col.column, other.column if other else None)


def _choose(r: Resolved, schema, grain, first, last, today, preference, estimate, facts_asked: bool) -> None:
    """The fact table.  Requests of dimensions alone have none."""
    if r.dimension_driven and not facts_asked:
        return
    columns = {i.column for i in r.items if i.kind in ("fact_dim", "metric") and i.column not in r.lookups} | {c.lookup.key for c in r.lookups.values()}
    for f in (*r.fact_filters, *r.having):
        columns |= f.fields()
    roots = {s.dim for s in r.steps if not s.via} | set(r.semi)
    if r.dimension_driven:
        near = r.registry.path(set().union(*(f.foreign_keys for f in r.cube.facts)), r.driving)
        if near is None:
            raise RequestError(f"cube {r.cube.name} has no way to {r.driving}")
        roots = {near[0][0]}
    found, why = candidates(r.cube, (last - first).days, estimate, columns=columns, keys=roots, schema=schema, grain=grain, first=first, last=last, today=today)
    engine = r.request.parameters.get("QueryEngine")
    if engine and found:
        found = [c for c in found if c.fact.engine.lower() == str(engine).lower()]
        why = why if found else {str(engine): "is the engine of none that could"}
    if not found:
        raise RequestError(f"no table of cube {r.cube.name} can answer: " + "; ".join(f"{k} {v}" for k, v in why.items()))
    r.high_cardinality = any(_names(f, own) for d, fs in r.dim_filters.items() for own in r.registry.dims[d].table.high_cardinality_filters for f in fs)
    r.choice = best(found, preference, r.high_cardinality)
    r.fact = r.choice[0].fact
    r.fact = replace(bound(r.fact, r.request.parameters), dims=(*bound(r.fact, r.request.parameters).dims, *r.lookups.values()))
    r.fact_filters = with_forced(r.fact_filters, r.fact.forced_filters)
    for f in r.fact_filters:
        _lengths(f, r.fact)
    for i in r.items:
        if i.kind == "metric":
            col = r.fact.column(i.column)
            if not isinstance(col, FactCol):
                raise RequestError(f"{i.column} is no metric of {r.fact.name}")
            if col.restricted_to and schema not in col.restricted_to:
                raise RequestError(f"{i.name} isn't for schema {schema}")


def _names(f: Filter, own: Filter) -> bool:
    """Whether a filter is one that a dimension declares as naming many keys: of its field and operator, and of its values if it has any."""
    if f.children:
        return any(_names(c, own) for c in f.children)
    return f.field == own.field and f.op == own.op and (not own.values or bool(set(map(str, f.values)) & set(map(str, own.values))))


def _lengths(f: Filter, table) -> None:
    for c in f.children:
        _lengths(c, table)
    if not f.children and (col := table.column(f.field)):
        check_length(f, col.type)
        if f.compare_to and (other := table.column(f.compare_to)) and type(other.type) is not type(col.type):
            raise RequestError(f"{f.field} and {f.compare_to} have different types")
