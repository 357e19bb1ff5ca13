"""What a registry offers, as JSON; tables' DDL from the model, and a model from tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .model import Cube, DimCol, DimTable, FactTable, IntType, ModelError, PublicDim, Registry, StrType, TimestampType


def cubes(registry: Registry) -> list[str]:
    return sorted({name for name, _ in registry.cubes})


def _field(alias: str, col: DimCol | None, public, kind: str) -> dict[str, Any]:
    out = {"field": alias, "type": kind, "dataType": col.type.spark if col else "string", "filterOperations": sorted(public.ops) if public.filterable else [], "required": public.required}
    if col is not None and getattr(col.type, "mapping", None):
        out["values"] = sorted(set(map(str, col.type.mapping.values())))
    if public.depends_on:
        out["dependsOn"] = list(public.depends_on)
    if public.incompatible:
        out["incompatible"] = list(public.incompatible)
    return out


def domain(registry: Registry, cube_name: str | None = None) -> dict[str, Any]:
    """Dimensions and cubes, cubes naming the dimensions that they reach."""
    return {"dimensions": [_dim(d) for d in sorted(registry.dims.values(), key=lambda d: d.name)], "schemas": _schemas(registry), "cubes": [_cube(registry, registry.cube(n)) for n in cubes(registry) if cube_name in (None, n)]}


def _dim(d: PublicDim) -> dict[str, Any]:
    return {"name": d.name, "level": d.table.level, "key": d.key_alias, "fields": [_field(c.alias, d.table.column(c.column), c, "Dimension") for c in d.columns if not c.hidden]}


def _cube(registry: Registry, cube: Cube) -> dict[str, Any]:
    col = lambda name: next((f.column(name) for f in cube.facts if f.column(name)), None)
    keys = set().union(*(f.foreign_keys for f in cube.facts))
    reach = sorted(d for d in registry.dims if registry.path(keys, d))
    fields = [_field(c.alias, col(c.column), c, "Dimension") for c in cube.dims if not c.hidden] + [_field(c.alias, col(c.column), c, "Fact") for c in cube.metrics if not c.hidden]
    return {"name": cube.name, "mainEntityIds": {d: d for d in sorted(keys)}, "maxDaysLookBack": [{"requestType": k, "grain": g, "days": v} for (k, g), v in sorted(cube.max_lookback.items())], "maxDaysWindow": [{"requestType": k, "grain": g, "days": v} for (k, g), v in sorted(cube.max_window.items())], "dimensions": reach, "fields": fields}


def _schemas(registry: Registry) -> dict[str, list[str]]:
    out: dict[str, set[str]] = {}
    for c in registry.cubes.values():
        for f in c.facts:
            for s in f.schemas:
                out.setdefault(s, set()).add(c.name)
    return {k: sorted(v) for k, v in sorted(out.items())}


def flat_domain(registry: Registry, cube_name: str | None = None) -> dict[str, Any]:
    """Each cube with the fields of all dimensions that it reaches."""
    out = []
    for c in domain(registry, cube_name)["cubes"]:
        extra = [f for d in c["dimensions"] for f in _dim(registry.dims[d])["fields"] if f["field"] not in {x["field"] for x in c["fields"]}]
        out.append({**{k: v for k, v in c.items() if k != "dimensions"}, "fields": c["fields"] + extra})
    return {"cubes": out}


def domain_frame(spark: SparkSession, registry: Registry, cube_name: str) -> DataFrame:
    """A row for each field of a cube."""
    rows = [(cube_name, f["field"], f["type"], f["dataType"], ",".join(f["filterOperations"])) for c in flat_domain(registry, cube_name)["cubes"] for f in c["fields"]]
    return spark.createDataFrame(rows, "cube string, field string, kind string, data_type string, operations string")


def ddl(table: FactTable | DimTable, *, using: str = "parquet") -> str:
    """CREATE TABLE of the physical columns, partitioned by those that are declared as partitions."""
    columns = table.columns if isinstance(table, DimTable) else (*table.dims, *table.metrics)
    own, parts = [], []
    for c in columns:
        if c.expr is not None or c.const is not None:
            continue
        name, kind = c.source or c.name, c.type.spark
        if name in [n for n, _ in own]:
            continue
        own.append((name, kind))
        if isinstance(c, DimCol) and c.partition:
            parts.append(name)
    body = ",\n  ".join(f"`{n}` {k.upper()}" for n, k in own)
    return f"CREATE TABLE IF NOT EXISTS `{table.table or table.name}` (\n  {body}\n) USING {using}" + (f"\nPARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else "")


def levels(keys: dict[str, dict[str, str]]) -> dict[str, int]:
    """Depth of each table by its foreign keys {table: {column: table}}: 1 without any."""
    out: dict[str, int] = {}

    def of(t: str, seen: tuple[str, ...] = ()) -> int:
        if t in seen:
            raise ModelError(f"foreign keys of {t} go round")
        if t not in out:
            out[t] = 1 + max((of(p, (*seen, t)) for p in keys.get(t, {}).values()), default=0)
        return out[t]

    for t in keys:
        of(t)
    return out


def dumped(schemas: dict[str, StructType], primary: dict[str, str], keys: dict[str, dict[str, str]]) -> dict[str, DimTable]:
    """Dimension tables of physical ones: types from their schemas, levels from their foreign keys."""
    depth, out = levels({t: keys.get(t, {}) for t in schemas}), {}
    kinds = {"int": IntType(), "bigint": IntType(), "smallint": IntType(), "timestamp": TimestampType(), "timestamp_ntz": TimestampType()}
    for t, schema in schemas.items():
        columns = tuple(DimCol(f.name, kinds.get(f.dataType.simpleString(), StrType()), primary_key=f.name == primary[t], foreign_key=keys.get(t, {}).get(f.name)) for f in schema)
        out[t] = DimTable(t, columns, level=depth[t])
    return out


def register_functions(spark: SparkSession, functions: dict[str, tuple[Any, str | None]]) -> list[str]:
    """SQL functions of an application, {name: (function, type)}, without a type for those that are vectorised already;
    built-in expressions are the faster way."""
    for name, (fn, kind) in functions.items():
        if kind is None:
            spark.udf.register(name, fn)
        else:
            spark.udf.register(name, fn, kind)
    return sorted(functions)
