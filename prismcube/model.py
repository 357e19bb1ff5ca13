"""Declarative model: columns, facts, dimensions, public cubes and the registry.  Plain data; no Spark needed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class ModelError(ValueError):
    """The declared model is inconsistent."""


# -- types ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class IntType:
    length: int = 0
    default: int | None = None
    min: int | None = None
    max: int | None = None
    mapping: dict[int, str] | None = None
    mapping_default: str | None = None
    spark = "bigint"


@dataclass(frozen=True)
class StrType:
    length: int = 0
    default: str | None = None
    mapping: dict[str, str] | None = None
    mapping_default: str | None = None
    binary: bool = False

    @property
    def spark(self) -> str:
        return "binary" if self.binary else "string"


@dataclass(frozen=True)
class DecType:
    length: int = 0
    scale: int | None = None
    default: float | None = None
    min: float | None = None
    max: float | None = None
    mapping = None
    spark = "double"


@dataclass(frozen=True)
class DateType:
    format: str | None = None
    mapping = None
    length = 0
    spark = "date"


@dataclass(frozen=True)
class TimestampType:
    format: str | None = None
    mapping = None
    length = 0
    spark = "timestamp"


@dataclass(frozen=True)
class PassthroughType:
    mapping = None
    length = 0
    spark = "string"


ColumnType = IntType | StrType | DecType | DateType | TimestampType | PassthroughType


# -- columns -------------------------------------------------------------------------------------------------------

#: Expressions are SQL over the names of the table's columns, or functions of a resolver name -> Column.
Expr = str | Callable[[Callable[[str], Column]], Column]



@dataclass(frozen=True)
class Lookup:
    """What a namespace says of a key, a column of the table.

    value: a column of the namespace, or expr: an expression over {columns} of it and {key}.  keys and values short-cut
    keys and rewrite what is found; retain: a miss gives the key; missing: a miss or an empty text gives it.  then: an
    expression over {value}, what has been found.
    """

    namespace: str
    key: str
    value: str | None = None
    expr: str | None = None
    keys: tuple[tuple[Any, str], ...] = ()
    values: tuple[tuple[str, str], ...] = ()
    retain: bool = False
    missing: str | None = None
    then: str | None = None

    def __post_init__(self):
        if (self.value is None) == (self.expr is None):
            raise ModelError(f"a lookup in {self.namespace} needs a value or an expression")
        if self.keys and self.values:
            raise ModelError("a map of keys and a map of values can't be used together")


EQUALITY = frozenset({"In", "=", "Not In", "<>"})
EVERY_OP = frozenset(
    {"In", "Not In", "Between", "DateTimeBetween", "=", "==", ">", "<", "Like", "Not Like", "<>", "IsNull", "IsNotNull", "Or", "And", "JavaScript"}
)


@dataclass(frozen=True)
class DimCol:
    """A column to group and filter by: of the table (`source`), constant, or derived from others."""

    name: str
    type: ColumnType = field(default_factory=StrType)
    source: str | None = None
    expr: Expr | None = None
    const: Any = None
    foreign_key: str | None = None  # name of the dimension
    primary_key: bool = False
    case_insensitive: bool = False
    day_format: str | None = None  # how a day is stored, for columns of int or string
    aggregate: bool = False  # declared as a dimension, but an aggregate: not grouped by
    partition: bool = False
    restricted_to: frozenset[str] = frozenset()
    uses: tuple[str, ...] = ()
    lookup: Lookup | None = None
    post: str | None = None  # over {value} and other columns of the result, once its page is there


@dataclass(frozen=True)
class FactCol:
    """A metric: a column and its rollup, or an expression over other metrics (after aggregation)."""

    name: str
    type: ColumnType = field(default_factory=DecType)
    rollup: Any = "sum"
    source: str | None = None
    expr: Expr | None = None
    const: Any = None
    restricted_to: frozenset[str] = frozenset()
    uses: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    incompatible: tuple[str, ...] = ()
    post: str | None = None


# -- tables --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FactTable:
    name: str
    dims: tuple[DimCol, ...]
    metrics: tuple[FactCol, ...]
    table: str | None = None  # underlying table; several, joined by commas, are a union
    grain: str = "daily"
    engine: str = "spark"
    schemas: frozenset[str] = frozenset({"default"})
    day_column: str | None = None
    time_column: str | None = None
    cost_multiplier: Any = None  # a RangeLookup, or None
    forced_filters: tuple = ()
    default_cardinality: int = 10
    default_rows: int = 100
    max_window: int | None = None
    max_lookback: int | None = None
    available_from: date | None = None
    level: int = 0
    views: tuple = ()  # branches of a union view: (table, constants, filters)
    parent: str | None = None

    def __post_init__(self):
        names = [c.name for c in (*self.dims, *self.metrics)]
        if len(set(names)) < len(names):
            raise ModelError(f"{self.name}: a column is declared twice")
        known = set(names)
        for c in (*self.dims, *self.metrics):
            for u in c.uses:
                if u not in known:
                    raise ModelError(f"{self.name}.{c.name} uses the unknown column {u}")

    def column(self, name: str) -> DimCol | FactCol | None:
        return next((c for c in (*self.dims, *self.metrics) if c.name == name), None)

    @property
    def foreign_keys(self) -> dict[str, str]:
        """dimension -> column."""
        return {c.foreign_key: c.name for c in self.dims if c.foreign_key}

    # Derivation of further physical tables ------------------------------------------------------------------------

    def new_rollup(self, name: str, discard: Sequence[str], *, available_from: date | None = None, table: str | None = None, **more) -> FactTable:
        """A pre-aggregated table without some dimensions; at least one foreign key stays."""
        for d in discard:
            if not isinstance(self.column(d), DimCol):
                raise ModelError(f"{d} isn't a dimension column of {self.name}")
        dims = tuple(c for c in self.dims if c.name not in discard and not set(c.uses) & set(discard))
        if not any(c.foreign_key for c in dims):
            raise ModelError("a rollup keeps a foreign key")
        if available_from is None:
            raise ModelError("a rollup needs the day from which it is available")
        return replace(self, name=name, dims=dims, table=table or name, available_from=available_from, level=self.level + 1, parent=self.name, **more)

    def subset(self, name: str, discard: Sequence[str], **more) -> FactTable:
        """Without some dimensions and metrics, on the same table."""
        gone = set(discard)
        keep = lambda c: c.name not in gone and not set(c.uses) & gone
        return replace(self, name=name, dims=tuple(filter(keep, self.dims)), metrics=tuple(filter(keep, self.metrics)), table=self.table or self.name, level=self.level + 1, parent=self.name, **more)

    def alternative_engine(self, name: str, engine: str, **more) -> FactTable:
        if engine == self.engine:
            raise ModelError("an alternative needs another engine")
        return replace(self, name=name, engine=engine, **{"table": self.table or self.name, "parent": self.name, **more})

    def available_onwards(self, name: str, day: date, **more) -> FactTable:
        return replace(self, name=name, available_from=day, **{"table": self.table or self.name, "parent": self.name, **more})

    def new_grain(self, name: str, grain: str, **more) -> FactTable:
        return replace(self, name=name, grain=grain, **{"table": self.table or self.name, "parent": self.name, **more})

    def new_schema(self, name: str, schemas: Sequence[str], **more) -> FactTable:
        return replace(self, name=name, schemas=frozenset(schemas), **{"table": self.table or self.name, "parent": self.name, **more})

    def new_schema_and_grain(self, name: str, schemas: Sequence[str], grain: str, **more) -> FactTable:
        return replace(self, name=name, schemas=frozenset(schemas), grain=grain, **{"table": self.table or self.name, "parent": self.name, **more})


def union_view(name: str, branches: Sequence[tuple[FactTable, dict[str, Any]]], **more) -> FactTable:
    """A fact over two tables or more of the same columns; each branch can set constant columns."""
    if len(branches) < 2:
        raise ModelError("a union view needs two branches")
    first = branches[0][0]
    const = {k for _, c in branches for k in c}
    shape = lambda t: ({c.name for c in t.dims} - const, {c.name for c in t.metrics})
    for t, c in branches:
        if shape(t) != shape(first):
            raise ModelError(f"{t.name} has other columns than {first.name}")
        if set(c) != const:
            raise ModelError(f"{t.name} doesn't set every constant column")
    dims = tuple(c for c in first.dims if c.name not in const) + tuple(DimCol(k, StrType()) for k in sorted(const))
    views = tuple((t, dict(c)) for t, c in branches)
    return replace(first, name=name, dims=dims, views=views, parent=None, **more)


@dataclass(frozen=True)
class DimTable:
    name: str
    columns: tuple[DimCol, ...]
    level: int = 1
    table: str | None = None
    engine: str = "spark"
    schemas: frozenset[str] = frozenset({"default"})
    forced_filters: tuple = ()
    high_cardinality_filters: tuple = ()
    schema_required: dict[str, str] = field(default_factory=dict)
    snapshot_column: str | None = None
    max_lookback: int | None = None

    def __post_init__(self):
        if sum(c.primary_key for c in self.columns) != 1:
            raise ModelError(f"{self.name}: one primary key is needed")

    @property
    def key(self) -> str:
        return next(c.name for c in self.columns if c.primary_key)

    @property
    def foreign_keys(self) -> dict[str, str]:
        return {c.foreign_key: c.name for c in self.columns if c.foreign_key}

    def column(self, name: str) -> DimCol | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass(frozen=True)
class PublicCol:
    """What a request sees of a column."""

    alias: str
    column: str
    ops: frozenset[str] = EVERY_OP
    required: bool = False
    depends_on: tuple[str, ...] = ()
    incompatible: tuple[str, ...] = ()
    restricted_to: frozenset[str] = frozenset()
    hidden: bool = False
    filterable: bool = True


@dataclass(frozen=True)
class Cube:
    """A public fact: aliases over candidate tables of different grains, engines and rollups."""

    name: str
    facts: tuple[FactTable, ...]
    dims: tuple[PublicCol, ...]
    metrics: tuple[PublicCol, ...]
    forced_filters: tuple = ()
    max_window: dict[tuple[str, str], int] = field(default_factory=dict)  # (sync or async, grain) -> days
    max_lookback: dict[tuple[str, str], int] = field(default_factory=dict)
    revision: int = 0
    schema_required: dict[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self):
        names = [c.alias for c in (*self.dims, *self.metrics)]
        if len(set(names)) < len(names):
            raise ModelError(f"{self.name}: an alias is declared twice")

    def public(self, alias: str) -> PublicCol | None:
        return next((c for c in (*self.dims, *self.metrics) if c.alias == alias), None)

    def is_metric(self, alias: str) -> bool:
        return any(c.alias == alias for c in self.metrics)

    def copy(self, name: str, **more) -> Cube:
        return replace(self, name=name, **more)


@dataclass(frozen=True)
class PublicDim:
    name: str
    table: DimTable
    columns: tuple[PublicCol, ...]
    forced_filters: tuple = ()
    revision: int = 0

    def public(self, alias: str) -> PublicCol | None:
        return next((c for c in self.columns if c.alias == alias), None)

    @property
    def key_alias(self) -> str:
        return next(c.alias for c in self.columns if c.column == self.table.key)

    def fk_alias(self, dim: str) -> str | None:
        col = self.table.foreign_keys.get(dim)
        return next((c.alias for c in self.columns if c.column == col), None) if col else None


@dataclass
class Registry:
    """All cubes and dimensions by name, each in its revisions."""

    cubes: dict[tuple[str, int], Cube] = field(default_factory=dict)
    dims: dict[str, PublicDim] = field(default_factory=dict)
    default_revision: dict[str, int] = field(default_factory=dict)

    def add(self, *items: Cube | PublicDim) -> Registry:
        for x in items:
            if isinstance(x, Cube):
                if (x.name, x.revision) in self.cubes:
                    raise ModelError(f"cube {x.name} has revision {x.revision} already")
                self.cubes[x.name, x.revision] = x
                self.default_revision[x.name] = max(self.default_revision.get(x.name, 0), x.revision)
            else:
                if x.name in self.dims:
                    raise ModelError(f"dimension {x.name} is there already")
                self.dims[x.name] = x
        return self

    def cube(self, name: str, revision: int | None = None) -> Cube | None:
        rev = self.default_revision.get(name) if revision is None else revision
        return self.cubes.get((name, rev))

    def dim_of_alias(self, alias: str) -> list[PublicDim]:
        """Dimensions with that alias; a key's own dimension first."""
        found = [d for d in self.dims.values() if d.public(alias)]
        return sorted(found, key=lambda d: (d.public(alias).column != d.table.key, d.table.level))

    def path(self, start: set[str], target: str) -> list[tuple[str, str]] | None:
        """Shortest chain of (dimension, over which dimension or '') from dimensions in reach to the target."""
        if target in start:
            return [(target, "")]
        came: dict[str, str] = {s: "" for s in start}
        queue = sorted(start, key=lambda s: -self.dims[s].table.level if s in self.dims else 0)
        while queue:
            at = queue.pop(0)
            for nxt in self.dims[at].table.foreign_keys if at in self.dims else ():
                if nxt in came:
                    continue
                came[nxt] = at
                if nxt == target:
                    chain = [nxt]
                    while came[chain[-1]]:
                        chain.append(came[chain[-1]])
                    chain.reverse()
                    return [(d, chain[i - 1] if i else "") for i, d in enumerate(chain)]
                queue.append(nxt)
        return None


def bound(table, context: dict[str, Any]):
    """The table with what a request says in the place of <name> in its expressions."""
    from .functions.derived import with_replacements
    from .operators.rollups import Custom

    def filled(c):
        changes = {k: with_replacements(v, context) for k in ("expr", "post") if isinstance(v := getattr(c, k), str) and "<" in v}
        rollup = getattr(c, "rollup", None)
        if isinstance(rollup, Custom) and isinstance(rollup.expr, str) and "<" in rollup.expr:
            changes["rollup"] = Custom(with_replacements(rollup.expr, context))
        if (k := getattr(c, "lookup", None)) is not None:
            inner = {n: with_replacements(v, context) for n in ("expr", "then") if isinstance(v := getattr(k, n), str) and "<" in v}
            if inner:
                changes["lookup"] = replace(k, **inner)
        return replace(c, **changes) if changes else c

    if isinstance(table, DimTable):
        return replace(table, columns=tuple(map(filled, table.columns)))
    return replace(table, dims=tuple(map(filled, table.dims)), metrics=tuple(map(filled, table.metrics)))


def column_type_cast(c: Column, type_: ColumnType) -> Column:
    return c.cast(type_.spark) if not isinstance(type_, PassthroughType) else c


def mapped(c: Column, type_: ColumnType) -> Column:
    """Codes to labels of a static mapping."""
    if not type_.mapping:
        return c
    out = None
    for code, label in type_.mapping.items():
        out = F.when(c == F.lit(code), F.lit(label)) if out is None else out.when(c == F.lit(code), F.lit(label))
    return out.otherwise(F.lit(type_.mapping_default))
