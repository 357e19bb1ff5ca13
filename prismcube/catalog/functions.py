"""Functions of derived expressions, of dimensions, and on the rows of a result: declared in a cube, and asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cubes.trade import registry, trade_engine
from ..functions import derived
from ..model import DateType, DecType, DimCol, FactCol, IntType, PublicCol, Registry, StrType
from ..operators.filters import F_in
from ..operators.rollups import NOOP, Custom, Theta, ThetaSetOp
from ..sources import folder
from . import E, L, query, register, request, where

derived.register_native("root of product", lambda a, b: F.sqrt(a * b))
derived.register_native("upper", F.upper)
derived.register_native("joined", lambda a, b: F.concat(a, F.lit("-"), b))
derived.register_native("twice", lambda a: a * 2)


def declared(cols: dict[str, DimCol | FactCol], at: str) -> Registry:
    """The trade registry with `cols`, by alias, in a cube or in a dimension."""
    r = registry()
    public = tuple(PublicCol(a, c.name) for a, c in cols.items())
    if (at, 0) in r.cubes:
        cube = r.cubes[at, 0]
        dims, metrics = (tuple(c for c in cols.values() if isinstance(c, kind)) for kind in (DimCol, FactCol))
        facts = tuple(replace(f, dims=(*f.dims, *dims), metrics=(*f.metrics, *metrics)) for f in cube.facts)
        own = {c.name for c in metrics}
        r.cubes[at, 0] = replace(cube, facts=facts, dims=(*cube.dims, *(p for p in public if p.column not in own)), metrics=(*cube.metrics, *(p for p in public if p.column in own)))
    else:
        d = r.dims[at]
        r.dims[at] = replace(d, table=replace(d.table, columns=(*d.table.columns, *cols.values())), columns=(*d.columns, *public, PublicCol("Key", d.table.key)))  # a name that the cube hasn't
    return r


def asked(name: str, at: str, cols: dict[str, Any], fields: dict[str, str], sql: str, *filters: dict, namespaces: Callable | None = None, **more) -> None:
    """cols: alias -> column, or the text of its expression.  fields: the others, alias -> field."""
    made = {a: DimCol(f"own_{a}", StrType(), expr=c) if isinstance(c, str) else replace(c, name=f"own_{a}") for a, c in cols.items()}

    def run(spark, sf_dir) -> DataFrame:
        engine = trade_engine(spark, sf_dir, registry=declared(made, at), namespaces=namespaces(spark, sf_dir) if namespaces else None)
        cube = at if at in ("sales", "activity") else "sales"
        return engine.frame(request(cube, {**fields, **{a: a for a in made}}, *filters, **more))

    register(name, run, sql)


def dim(expr: str, kind=None, **more) -> DimCol:
    return DimCol("", kind or StrType(), expr=expr, **more)


#: Every order, as the dimension leaves those of one status out otherwise.
ALL = where("Order Status", "In", "Open", "Filled", "Partial")


def part(name: str, cols: dict[str, Any], sql: str, **more) -> None:
    asked(name, "part", cols, {"id": "Key", **more.pop("fields", {})}, f"SELECT p_partkey AS id, {sql} FROM part", **more)


def orders(name: str, cols: dict[str, Any], sql: str, **more) -> None:
    asked(name, "orders", cols, {"id": "Key", **more.pop("fields", {})}, f"SELECT o_orderkey AS id, {sql} FROM orders", ALL, **more)


def event(name: str, cols: dict[str, Any], sql: str, test: str = E, **more) -> None:
    asked(name, "activity", cols, {"id": "Event ID"}, f"SELECT event_id AS id, {sql} FROM events WHERE {test}", **more)


def lines(name: str, cols: dict[str, FactCol], sql: str) -> None:
    asked(name, "sales", cols, {"flag": "Flag"}, f"SELECT l_returnflag AS flag, {sql} FROM lineitem WHERE {L} GROUP BY 1")


def metric(expr: str, kind=None, **more) -> FactCol:
    return FactCol("", kind or IntType(), NOOP, expr=expr, **more)


part("fn_arith", {"up": "{p_retailprice} * 2 + {p_size} - 1", "per": "{p_retailprice} / ({p_size} - 5)"}, "p_retailprice * 2 + p_size - 1 AS up, p_retailprice / nullif(p_size - 5, 0) AS per")
part("fn_safe_div", {"per": "{p_retailprice} /- ({p_size} - 5)"}, "CASE WHEN p_size = 5 THEN 0.0 ELSE p_retailprice / (p_size - 5) END AS per")
lines("fn_sum", {"s": metric("sum({l_quantity} * {l_linenumber})", DecType(scale=2))}, "round(sum(l_quantity * l_linenumber), 2) AS s")
lines("fn_max", {"v": metric("max({l_linenumber}) + 1")}, "max(l_linenumber) + 1 AS v")
lines("fn_min", {"v": metric("min({l_extendedprice}) * 2", DecType(scale=4))}, "round(min(l_extendedprice) * 2, 4) AS v")
lines("fn_count", {"n": metric("count({l_partkey})")}, "count(l_partkey) AS n")
lines("fn_count_distinct", {"n": metric("count_distinct({l_suppkey})")}, "count(DISTINCT l_suppkey) AS n")
lines("fn_decode", {"open": FactCol("", IntType(), "sum", expr="decode({l_linestatus}, 'O', 1, 0)"), "weight": FactCol("", DecType(scale=2), Custom("sum(decode({l_linestatus}, 'O', {l_quantity}, 0))"))}, "CAST(sum(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open, CAST(round(sum(CASE l_linestatus WHEN 'O' THEN l_quantity ELSE 0 END), 2) AS DOUBLE) AS weight")
orders("fn_round", {"v": "round({o_totalprice}, 1)"}, "round(o_totalprice, 1) AS v")
asked("fn_trunc", "customer", {"v": "trunc({c_acctbal})"}, {"id": "Key"}, "SELECT c_custkey AS id, CAST(trunc(c_acctbal) AS BIGINT) AS v FROM customer")
event("fn_trunc_date", {"v": dim("trunc({ts}, 'date')", DateType())}, "CAST(date_trunc('day', ts) AS DATE) AS v")
part("fn_coalesce", {"v": "coalesce(nullif({p_type}, 'PROMO'), {p_brand})"}, "coalesce(nullif(p_type, 'PROMO'), p_brand) AS v")
part("fn_nvl", {"v": "nvl(nullif({p_type}, 'PROMO'), 'none')"}, "coalesce(nullif(p_type, 'PROMO'), 'none') AS v")
orders("fn_decode_dim", {"a": "decode_dim({o_orderstatus}, 'O', 'open', 'F', 'full')", "b": "decode_dim({o_orderstatus}, 'O', 'open', 'rest')"}, "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'full' END AS a, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'rest' END AS b")
asked("fn_compare_percentage", "sales", {"v": "compare_percentage({l_tax}, {l_discount}, 50, 'low', compare_percentage({l_tax}, {l_discount}, 100, 'mid', 'high'))"}, {"n": "Lines"}, f"SELECT CASE WHEN l_tax < 0.5 * l_discount THEN 'low' WHEN l_tax < 1.0 * l_discount THEN 'mid' ELSE 'high' END AS v, count(*) AS n FROM lineitem WHERE {L} GROUP BY 1")
part("fn_trim", {"v": "trim(concat('  ', {p_name}, ' '))"}, "trim('  ' || p_name || ' ') AS v")
part("fn_regex_extract", {"a": "regex_extract({p_brand}, '#(1\\d*)', 1)", "b": "regex_extract({p_brand}, '#(1\\d*)', 1, 'none')"}, "regexp_extract(p_brand, '#(1\\d*)', 1) AS a, CASE WHEN length(regexp_extract(p_brand, '#(1\\d*)', 1)) > 0 THEN regexp_extract(p_brand, '#(1\\d*)', 1) ELSE 'none' END AS b")
orders("fn_interval_date", {k: dim(f"get_interval_date({{o_orderdate}}, '{k}')", DateType() if k in "dwm" else StrType()) for k in ("d", "w", "m", "day", "yr")}, "CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, dayname(o_orderdate) AS day, CAST(year(o_orderdate) AS VARCHAR) AS yr")
orders("fn_format_date", {"v": "format_date(decode({o_orderstatus}, 'O', {o_orderdate}, 'F', {o_orderdate}), 'yyyyMMdd')"}, "coalesce(strftime(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END, '%Y%m%d'), 'NULL') AS v")
orders("fn_format_date_least", {"v": "format_date_with_least(decode({o_orderstatus}, 'P', '4000-05-05', format_date({o_orderdate}, 'yyyy-MM-dd')), 'yyyy-MM-dd')"}, "strftime(least(CAST(CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '4000-05-05' ELSE o_orderdate END AS DATE), DATE '3000-01-01'), '%Y-%m-%d') AS v")
event("fn_ts_to_date", {"v": "timestamp_to_formatted_date(decode({event_type}, 'error', nullif(1, 1), 1700000000000 + {event_id} * 60000), 'yyyy-MM-dd HH:mm')"}, "CASE WHEN event_type = 'error' THEN 'NULL' ELSE strftime(make_timestamp((1700000000000 + event_id * 60000) * 1000), '%Y-%m-%d %H:%M') END AS v")
event("fn_to_char", {"v": "to_char({ts}, 'dd.MM.yyyy HH')"}, "strftime(ts, '%d.%m.%Y %H') AS v")
event("fn_day_of_week", {"v": "day_of_week(to_char({ts}, 'yyyyMMdd'), 'yyyyMMdd')"}, "dayname(ts) AS v")
ZONED = "time_format_with_timezone(to_char({ts}, 'yyyy-MM-dd HH:mm:ss'), 'yyyy-MM-dd HH:mm:ss', 'yyyy-MM-dd HH', '<TimeZone|America/New_York>')"
TOKYO = "ts >= TIMESTAMP '2023-12-31 15:00:00' AND ts < TIMESTAMP '2024-01-31 15:00:00'"
event("fn_time_format_tz", {"v": ZONED}, "strftime((date_trunc('second', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H') AS v")
event("fn_time_format_tz_of_request", {"v": ZONED}, "strftime((date_trunc('second', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H') AS v", TOKYO, additionalParameters={"TimeZone": "Asia/Tokyo"})
part("fn_video_weighted", {"v": "video_weighted({p_size}, 2, {p_size}, 1)"}, "CAST(25 * p_size + 50 * 2 + 75 * p_size + 100 * 1 AS DOUBLE) AS v")
part("fn_video_sum", {"v": "video_sum({p_size}, {p_partkey}, 1, 2)"}, "p_size + p_partkey + 1 + 2 AS v")
part("fn_col_replacements", {"v": "{p_size} * <factor>", "w": "concat({p_brand}, ' of <owner|no one>')"}, "p_size * 3 AS v, p_brand || ' of no one' AS w", additionalParameters={"factor": 3})
part("fn_druid_const", {"v": "{p_size} + 0.5"}, "CAST(p_size + 0.5 AS DOUBLE) AS v")
part("fn_druid_field", {"v": "{p_size}"}, "p_size AS v")
part("fn_druid_js", {"v": "javascript('root of product', {p_size}, {p_retailprice})"}, "sqrt(p_size * p_retailprice) AS v")

event("dimfn_interval_date", {"v": "interval_text(to_char({ts}, 'yyyyMMdd'), 'yyyyMMdd', 'yyyy/MM')"}, "strftime(ts, '%Y/%m') AS v")
event("dimfn_day_of_week", {"v": "day_of_week(to_char({ts}, 'yyyy-MM-dd'), 'yyyy-MM-dd')"}, "dayname(ts) AS v")
part("dimfn_substr", {"v": "substr({p_brand}, 2, 3)"}, "substring(p_brand, 3, 3) AS v")
orders("dimfn_decode_dim", {"a": "decode_retain({o_orderstatus}, 'O', 'open')", "b": "decode_retain({o_orderstatus}, 'O', 'open', 'rest')"}, "CASE o_orderstatus WHEN 'O' THEN 'open' ELSE o_orderstatus END AS a, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'rest' END AS b")
part("dimfn_js", {"v": "javascript('upper', {p_type})"}, "upper(p_type) AS v")
part("dimfn_js_multi", {"v": "javascript('joined', {p_type}, {p_brand})"}, "p_type || '-' || p_brand AS v")
part("dimfn_regex", {"v": "regex_extract({p_name}, '(\\w+) (\\w+)', 2)"}, "regexp_extract(p_name, '(\\w+) (\\w+)', 2) AS v")
event("dimfn_time_format", {"v": "time_format({ts}, 'yyyyMMddHH', 'Asia/Tokyo')"}, "strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y%m%d%H') AS v")
event("dimfn_time_format_period", {"v": "time_format_period({ts}, 'yyyy-MM-dd', 'P1W')"}, "strftime(date_trunc('week', ts), '%Y-%m-%d') AS v")
event("dimfn_time_format_ctx", {"v": "time_format({ts}, 'yyyy-MM-dd HH:mm', '<TimeZone|UTC>')"}, "strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M') AS v", TOKYO, additionalParameters={"TimeZone": "Asia/Tokyo"})
asked("dimfn_group_filter", "activity", {"v": "to_char({ts}, 'HH')"}, {"n": "Events"}, f"SELECT strftime(ts, '%H') AS v, count(*) AS n FROM events WHERE {E} AND strftime(ts, '%H') IN ('07', '19') GROUP BY 1", where("v", "In", "07", "19"))

orders("post_decode", {"v": DimCol("", StrType(), source="o_orderstatus", post="decode({value}, 'P', {o_orderpriority}, 'O', 'open', {value})")}, "o_orderpriority AS p, CASE o_orderstatus WHEN 'P' THEN o_orderpriority WHEN 'O' THEN 'open' ELSE o_orderstatus END AS v", fields={"p": "Priority"})
orders("post_week_start", {"v": dim("iso_week({o_orderdate})", post="start_of_the_week({value})"), "w": "iso_week({o_orderdate})"}, "strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS v, isoyear(o_orderdate) || '-' || weekofyear(o_orderdate) AS w")
orders("post_month_start", {"v": DimCol("", DateType(), source="o_orderdate", post="start_of_the_month({value})")}, "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS v")
part("post_js", {"v": dim("{p_size}", post="javascript('twice', {value})")}, "p_size * 2 AS v")
orders("post_date_fmt", {"v": dim("to_char({o_orderdate}, 'yyyyMMdd')", post="day_text({value}, 'yyyyMMdd')")}, "strftime(o_orderdate, '%Y-%m-%d') AS v")
part("post_number", {"v": dim("{p_size} / 4", post="number({value}, 0)")}, "CAST(round_even(p_size / 4, 0) AS DOUBLE) AS v")
asked("post_metric", "sales", {"v": FactCol("", DecType(scale=4), NOOP, expr="{price} /- {quantity}", uses=("price", "quantity"), post="number({value}, 1)")}, {"supplier": "Supplier ID", "u": "Unit Price"}, f"SELECT l_suppkey AS supplier, round(sum(l_extendedprice) / sum(l_quantity), 6) AS u, round_even(round(sum(l_extendedprice) / sum(l_quantity), 4), 1) AS v FROM lineitem WHERE {L} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", sort=[("u", "DESC"), ("supplier", "ASC")], rowsPerPage=20)
asked("join_range_lookup", "sales", {"class": "in_ranges({l_quantity}, 0, 10, 'small', 10, 30, 'medium', 30, 45, 'large')"}, {"lines": "Lines"}, f"SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' WHEN l_quantity < 45 THEN 'large' END AS class, count(*) AS lines FROM lineitem WHERE {L} GROUP BY 1")
USERS = "SELECT user_id FROM events WHERE " + E + " AND event_type = "
asked("set_theta", "activity", {"both": FactCol("", IntType(), ThetaSetOp("INTERSECT", tuple(Theta("user_id", where=(F_in("kind", k),)) for k in ("purchase", "click"))))}, {}, f"SELECT count(*) AS both FROM ({USERS} 'purchase' INTERSECT {USERS} 'click')")


@query("udf_register", "SELECT p_partkey AS id, lower(p_type) || '!' AS v FROM part")
def _(spark, sf_dir):
    """A function of an application, vectorised over Arrow batches."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from ..metadata import register_functions

    def shout(s: pd.Series) -> pd.Series:
        return s.str.lower() + "!"

    shout.__annotations__ = {"s": pd.Series, "return": pd.Series}  # the module's annotations are texts
    register_functions(spark, {"own_shout": (pandas_udf(shout, "string"), None)})
    return folder(spark, sf_dir)("part").selectExpr("p_partkey as id", "own_shout(p_type) as v")
