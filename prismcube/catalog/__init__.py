"""One query for each operator, over the trade tables, with the same answer as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
PARTS = ("filters", "joins", "aggregates", "functions", "lookups", "results", "analyses", "tables")

SALES_DAYS = {"field": "Day", "operator": "Between", "from": "1995-01-01", "to": "2001-12-31"}
EVENT_DAYS = {"field": "Day", "operator": "Between", "from": "2024-01-01", "to": "2024-01-31"}
#: The same windows in SQL; they hold all rows of the tables.
L = "l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2002-01-01'"
E = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"


def request(cube: str, fields: dict[str, str], *filters: dict, day: dict | None = None, sort: list[tuple[str, str]] = (), **more) -> dict:
    """fields: alias -> field.  All rows, unless rowsPerPage is given."""
    day = day or (EVENT_DAYS if cube == "activity" else SALES_DAYS)
    return {
        "cube": cube, "selectFields": [{"field": f, "alias": a} if not isinstance(f, tuple) else {"field": f[0], "alias": a, "value": f[1]} for a, f in fields.items()],
        "filterExpressions": [day, *filters], "sortBy": [{"field": f, "order": o} for f, o in sort], "rowsPerPage": -1, **more,
    }


def where(field: str, operator: str, *values, **more) -> dict:
    if operator.lower() in ("in", "not in"):
        return {"field": field, "operator": operator, "values": list(values), **more}
    if operator.lower() in ("between", "datetimebetween"):
        return {"field": field, "operator": operator, "from": values[0], "to": values[1], **more}
    return {"field": field, "operator": operator, **({"value": values[0]} if values else {}), **more}


def ask(name: str, body: dict, sql: str | None = None, **engine) -> None:
    """Registers a request."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..cubes.trade import trade_engine

        made = {k: v() if callable(v) and k == "registry" else v for k, v in engine.items()}
        return trade_engine(spark, sf_dir, **made).frame(body)

    register(name, run, sql)


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in _queries:
        raise ValueError(f"{name} is registered twice")
    _queries[name] = run
    if sql:
        _sql[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        register(name, run, sql)
        return run

    return add


def _load() -> None:
    for p in PARTS:
        import_module(f"{__name__}.{p}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
