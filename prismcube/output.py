"""Results as CSV, JSON, one concatenated column, and the envelope of an API."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Cube
from .plans.lower import TOTAL
from .plans.resolve import Resolved


def concat_row(columns: list[Column], separator: str = ",") -> Column:
    """One string of all columns; null is empty."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def concatenated(df: DataFrame, name: str = "line") -> DataFrame:
    return df.select(concat_row([F.col(f"`{c}`") for c in df.columns]).alias(name))


def write_csv(df: DataFrame, path: str, *, header: bool = True, separator: str = ",", quote: str = '"', escape: str = '"', mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=str(header).lower(), sep=separator, quote=quote, escape=escape, emptyValue="").csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def json_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """A JSON array of the values for each row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def csv_lines(df: DataFrame, *, header: bool = True, separator: str = ",") -> Iterator[str]:
    """Lines of a result that is a page, streamed partition by partition."""

    def quoted(v: Any) -> str:
        s = "" if v is None else str(v)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in (separator, '"', "\n", "\r")) else s

    _bounded(df)
    if header:
        yield separator.join(map(quoted, df.columns))
    for row in df.toLocalIterator():
        yield separator.join(map(quoted, row))


def _bounded(df: DataFrame) -> None:
    """What goes through the driver is a page: a plan that ends without a limit is refused."""
    kind = df._jdf.queryExecution().optimizedPlan()
    if kind.maxRows().isEmpty():
        raise ValueError("only a page can be streamed through the driver: set rowsPerPage, or use write_csv or write_json")


def envelope(r: Resolved, df: DataFrame, curators: dict[str, DataFrame] | None = None, *, debug: bool = False) -> Iterator[str]:
    """{"header": {cube, fields, maxRows}, "rows": [...], "curators": {...}} in pieces; rows are streamed, as a page can be long."""
    kinds = {"metric": "FACT", "const": "CONSTANT"}
    fields = [{"fieldName": i.name, "fieldType": kinds.get(i.kind, "DIM")} for i in r.items]
    if TOTAL in df.columns:
        fields.append({"fieldName": TOTAL, "fieldType": "CONSTANT"})
    header: dict[str, Any] = {"cube": r.cube.name, "fields": fields, "maxRows": r.request.rows}
    if debug:
        header["debug"] = {"table": r.fact.name if r.fact else None, "engine": r.fact.engine if r.fact else None}
    yield '{"header":' + json.dumps(header) + ',"rows":['
    yield from _rows(df)
    yield '],"curators":{'
    for n, (name, out) in enumerate((curators or {}).items()):
        yield ("," if n else "") + json.dumps(name) + ':{"fields":' + json.dumps(out.columns) + ',"rows":['
        yield from _rows(out)
        yield "]}"
    yield "}}"


def _rows(df: DataFrame) -> Iterator[str]:
    _bounded(df)
    for n, row in enumerate(df.toLocalIterator()):
        yield ("," if n else "") + json.dumps(list(row), default=str)


def field_types(cube: Cube) -> dict[str, str]:
    return {**{c.alias: "DIM" for c in cube.dims}, **{c.alias: "FACT" for c in cube.metrics}}
