"""Rollups: how a metric is aggregated, and how it is cleaned afterwards.

A metric is aggregates of primitives plus an expression over them, so that a second aggregation above a join can sum
the primitives again and compute the expression last; averages are never averaged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DecType, FactCol, IntType, ModelError
from .filters import Filter


@dataclass(frozen=True)
class Filtered:
    """Only rows that match take part; several filters have to match all."""

    filters: tuple[Filter, ...]
    column: str
    rollup: str = "sum"

    @classmethod
    def listed(cls, filters, column: str, rollup: str = "sum") -> Filtered:
        if len(filters) < 2:
            raise ModelError("a list of filters has two at least")
        return cls(tuple(filters), column, rollup)


@dataclass(frozen=True)
class Cardinality:
    """Distinct values over the fields (by_row: of their tuples); approximate, or exact."""

    fields: tuple[str, ...]
    by_row: bool = False
    exact: bool = False
    error: float = 0.02


@dataclass(frozen=True)
class HyperUnique:
    column: str
    lg_k: int = 12


@dataclass(frozen=True)
class Theta:
    """Distinct values, counted exactly.  `where`: filters of its rows.  lg_k: the size of a sketch, where ThetaSetOp needs one."""

    column: str
    lg_k: int = 14
    where: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class ThetaSetOp:
    """INTERSECT, UNION or NOT over the values of other metrics: counted exactly where those are of one column, else estimated by
    sketches, which are exact while fewer than 2**lg_k distinct values come."""

    op: str
    parts: tuple[Theta, ...]


@dataclass(frozen=True)
class Custom:
    """An expression over aggregates, e.g. "sum(a * b) /- sum(b)"."""

    expr: str | Callable


@dataclass(frozen=True)
class RoundingSum:
    """A sum in double, rounded half up at the end."""

    scale: int = 2


NOOP = "noop"


def zero_safe(n: Column, d: Column) -> Column:
    """0.0 where the denominator is 0; null where it is null."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def simple(kind: str, c: Column, type_=None) -> Column:
    if kind == "sum":
        return F.sum(c.cast("bigint") if isinstance(type_, IntType) else c)
    if kind in ("max", "min", "avg"):
        return getattr(F, kind)(c)
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "count_distinct":
        return F.count_distinct(c)
    raise ModelError(f"unknown rollup {kind}")


def theta(t: Theta, column: Column) -> Column:
    return F.theta_sketch_agg(column, F.lit(t.lg_k))


def theta_set(op: str, parts: tuple[Theta, ...], sketches: list[Column]) -> Column:
    size = F.lit(max(t.lg_k for t in parts))
    fn = {"INTERSECT": F.theta_intersection, "UNION": lambda a, b: F.theta_union(a, b, size), "NOT": F.theta_difference}[op.upper()]
    return F.theta_sketch_estimate(reduce(fn, sketches))


def theta_counts(op: str, parts: tuple[Theta, ...], count: Callable[[tuple[Theta, ...]], Column]) -> Column | None:
    """A set operation as a sum of counts, count(parts) being that of the distinct values of all parts together, which can be grouped by below a
    join; those are 2**n - 1 counts for an INTERSECT of n parts.  None for parts of several columns."""
    op = op.upper()
    if len({t.column for t in parts}) > 1:
        return None
    if op == "UNION" or len(parts) == 1:
        return count(parts)
    if op == "NOT":
        return count(parts) - count(parts[1:])
    each = [(n, some) for n in range(1, len(parts) + 1) for some in combinations(parts, n)]
    return reduce(lambda out, x: out + count(x[1]) if x[0] % 2 else out - count(x[1]), each[1:], count(each[0][1]))


def clean(c: Column, col: FactCol, *, derived: bool) -> Column:
    """Derived values outside [min, max] become the default; then rounding; then the default for null."""
    t = col.type
    if not isinstance(t, DecType | IntType):
        return c
    out = c
    if derived and (t.min is not None or t.max is not None):
        ok = F.lit(True)
        if t.min is not None:
            ok = ok & (out >= F.lit(t.min))
        if t.max is not None:
            ok = ok & (out <= F.lit(t.max))
        out = F.when(ok, out).otherwise(F.lit(t.default) if t.default is not None else F.lit(None))
    if isinstance(t, DecType) and (t.scale is not None or derived):
        out = F.round(out, t.scale if t.scale is not None else 10)
    return F.coalesce(out, F.lit(t.default)) if t.default is not None else out
