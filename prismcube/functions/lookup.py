"""Lookups: enrichment of a key from a namespace.

A namespace is a DataFrame of one row a key.  Each lookup is a left join on the key, which Spark broadcasts or shuffles
by the namespace's measured size.  A miss gives null, unless the kind of lookup says otherwise; a null or empty key gives
null.  A cube declares lookups as columns (`model.Lookup`), which the planner attaches by `attach` and computes by `value`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Lookup
from .derived import decode, parse, references

class LookupError_(ValueError):
    """A lookup is declared wrongly."""


class Namespace:
    """Lookup values by key; of several rows with a key the latest by `updated` counts."""

    def __init__(self, name: str, df: DataFrame, key: str, *, updated: str | None = None):
        if updated:
            best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), updated).alias("_v"))
            df = best.select(key, "_v.*")
        self.name, self.df, self.key = name, df, key

    def introspect(self, what: str = "entries", limit: int | None = None) -> DataFrame:
        """keys, values or entries, at most `limit` of them."""
        out = {"keys": lambda: self.df.select(self.key), "values": lambda: self.df.drop(self.key), "entries": lambda: self.df}[what]()
        return out.limit(limit) if limit else out


def _override(value: Column, mapping: dict | None, on: Column) -> Column:
    if not mapping:
        return value
    return decode(on, *[x for kv in mapping.items() for x in kv], value)


def attach(df: DataFrame, ns: Namespace, key: str, columns: list[str]) -> DataFrame:
    """The namespace's columns as _<name>, null where the key is missing, null or empty."""
    held = ns.df.select(F.col(ns.key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    k = F.col(key) if dict(df.dtypes)[key] != "string" else F.when(F.col(key) != "", F.col(key))
    return df.join(held, k == F.col("_key"), "left").drop("_key")


def value(look: Lookup, key: Column, found: Callable[[str], Column]) -> Column:
    """What a declared lookup gives; found: the Column of a namespace's column."""
    v = found(look.value).cast("string") if look.value else parse(look.expr, lambda n: key if n == "key" else found(n))
    v = _override(v, dict(look.keys), key)
    v = _override(v, dict(look.values), v)
    if look.retain:
        v = F.coalesce(v, key.cast("string"))
    if look.then:
        v = parse(look.then, lambda n: key if n == "key" else v)
    if look.missing is not None:
        v = F.when(F.coalesce(v, F.lit("")) == "", F.lit(look.missing)).otherwise(v)
    return v


def columns_of(look: Lookup) -> list[str]:
    return [look.value] if look.value else [n for n in references(look.expr) if n != "key"]
