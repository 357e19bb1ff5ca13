"""Filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import Filter, expanded_days
from ..sources import folder
from . import E, L, ask, query, request, where

FLAGS = {"flag": "Flag", "status": "Line Status", "quantity": "Quantity", "lines": "Lines"}
SQL = "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS lines FROM lineitem WHERE " + L + " AND {} GROUP BY 1, 2"
KINDS = {"kind": "Kind", "events": "Events", "value": "Value"}
EVENTS = "SELECT event_type AS kind, count(*) AS events, round(sum(value), 2) AS value FROM events WHERE " + E + " AND {} GROUP BY 1"


def line(name: str, filters: list[dict], sql: str, **more) -> None:
    ask(name, request("sales", FLAGS, *filters, **more), SQL.format(sql))


def event(name: str, filters: list[dict], sql: str, **more) -> None:
    ask(name, request("activity", KINDS, *filters, **more), EVENTS.format(sql))


line("flt_in", [where("Flag", "In", "R", "A")], "l_returnflag IN ('R', 'A')")
line("flt_not_in", [where("Flag", "Not In", "R")], "l_returnflag NOT IN ('R')")
line("flt_between", [where("Line", "Between", 2, 4)], "l_linenumber BETWEEN 2 AND 4")
line("flt_eq", [where("Line Status", "=", "F")], "l_linestatus = 'F'")
line("flt_gt", [where("Line", ">", 5)], "l_linenumber > 5")
line("flt_lt", [where("Line", "<", 3)], "l_linenumber < 3")
line("flt_ne", [where("Flag", "<>", "N")], "l_returnflag <> 'N'")
line("flt_is_not_null", [where("Flag", "IsNotNull")], "l_returnflag IS NOT NULL")
line("flt_and", [{"operator": "And", "filterExpressions": [where("Flag", "=", "R"), where("Line", ">", 2)]}], "(l_returnflag = 'R' AND l_linenumber > 2)")
line("flt_or", [{"operator": "Or", "filterExpressions": [where("Flag", "=", "R"), where("Line", ">", 5)]}], "(l_returnflag = 'R' OR l_linenumber > 5)")
line("flt_static_map", [where("Settled", "=", "Settled")], "l_returnflag IN ('R', 'A')")
line("flt_static_map_not", [where("Settled", "<>", "Settled")], "l_returnflag NOT IN ('R', 'A')")
line("flt_pushdown", [where("Supplier ID", "In", 1, 2, 3)], "l_suppkey IN (1, 2, 3)")
line("flt_day_equal", [], "l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-05-06'", day=where("Day", "Between", "1996-01-01", "1996-05-05"))
line("flt_day_in", [], "CAST(l_shipdate AS DATE) IN (DATE '1996-05-05', DATE '1997-02-03')", day=where("Day", "In", "1996-05-05", "1997-02-03"))
event("flt_like", [where("Kind", "Like", "CLI")], "contains(lower(event_type), 'cli')")
event("flt_not_like", [where("Kind", "Not Like", "i")], "NOT contains(lower(event_type), 'i')")
event("flt_like_literal", [where("Props", "Like", "%")], "contains(props, '%')")
event("flt_case_insensitive", [where("Kind", "In", "CLICK", "View")], "lower(event_type) IN ('click', 'view')")
event("flt_field_eq", [where("User ID", "==", compareTo="User Twin")], "user_id = user_id")
event("flt_datetime_between", [], "ts BETWEEN TIMESTAMP '2024-01-06 08:30:00' AND TIMESTAMP '2024-01-09 17:15:30'", day=where("Day", "DateTimeBetween", "2024-01-06 08:30:00", "2024-01-09 17:15:30"))
event("flt_datetime_between_format", [], "ts BETWEEN TIMESTAMP '2024-01-06 08:30:00' AND TIMESTAMP '2024-01-09 17:15:30'", day=where("Day", "DateTimeBetween", "06/01/2024 08:30:00", "09/01/2024 17:15:30", format="dd/MM/yyyy HH:mm:ss"))
event("flt_datetime_column", [where("At", "DateTimeBetween", "2024-01-06 08:30:00", "2024-01-09 17:15:30")], "ts BETWEEN TIMESTAMP '2024-01-06 08:30:00' AND TIMESTAMP '2024-01-09 17:15:30'")
event("flt_is_null", [where("Props", "IsNull")], "props IS NULL")
event("flt_day_hour_minute", [where("Hour", "Between", "06", "11"), where("Minute", "Between", "15", "44")], "ts >= TIMESTAMP '2024-01-05 06:15:00' AND ts < TIMESTAMP '2024-01-20 11:45:00'", day=where("Day", "Between", "2024-01-05", "2024-01-20"))
event("flt_day_hour", [where("Hour", "=", "07")], "ts >= TIMESTAMP '2024-01-08 07:00:00' AND ts < TIMESTAMP '2024-01-08 08:00:00'", day=where("Day", "=", "2024-01-08"))
ask(
    "flt_metric_having",
    request("sales", {"supplier": "Supplier ID", "quantity": "Quantity", "lines": "Lines"}, where("Quantity", ">", 15200), where("Lines", "Between", 10, 610)),
    f"SELECT l_suppkey AS supplier, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS lines FROM lineitem WHERE {L} GROUP BY 1 HAVING sum(l_quantity) > 15200 AND count(*) BETWEEN 10 AND 610",
)
ask(
    "flt_or_metrics",
    request("sales", {"supplier": "Supplier ID", "quantity": "Quantity", "lines": "Lines"}, {"operator": "Or", "filterExpressions": [where("Quantity", "<", 15000), where("Lines", ">", 620)]}),
    f"SELECT l_suppkey AS supplier, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS lines FROM lineitem WHERE {L} GROUP BY 1 HAVING sum(l_quantity) < 15000 OR count(*) > 620",
)
ASKED = {"order_id": "Order ID", "order_status": "Order Status", "quantity": "Quantity"}
ask(
    "flt_outer",
    request("sales", ASKED, {"operator": "Outer", "outerFilters": [where("order_status", "IsNull")]}),
    f"SELECT l_orderkey AS order_id, CAST(NULL AS VARCHAR) AS order_status, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey WHERE {L} AND o_orderkey IS NULL GROUP BY 1",
)
STATUS = "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' WHEN 'P' THEN 'Partial' ELSE 'Unknown' END"
ask(
    "flt_forced",
    request("sales", {"order_status": "Order Status", "quantity": "Quantity"}, where("Priority", "=", "1-URGENT")),
    f"SELECT {STATUS} AS order_status, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {L} AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' GROUP BY 1",
)
ask(
    "flt_forced_overridden",
    request("sales", {"order_status": "Order Status", "quantity": "Quantity"}, where("Order Status", "In", "Partial", "Open")),
    f"SELECT {STATUS} AS order_status, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {L} AND o_orderstatus IN ('P', 'O') GROUP BY 1",
)
ask(
    "flt_dim_like",
    request("sales", {"customer_id": "Customer ID", "quantity": "Quantity"}, where("Customer", "Like", "CUSTOMER#00000000")),
    f"SELECT c_custkey AS customer_id, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' JOIN customer ON o_custkey = c_custkey WHERE {L} AND contains(lower(c_name), 'customer#00000000') GROUP BY 1",
)


def _required():
    from ..cubes.trade import registry
    from dataclasses import replace

    r = registry()
    cube = r.cubes["sales", 0]
    r.cubes["sales", 0] = replace(cube, facts=tuple(replace(f, schemas=frozenset({"default", "seller"})) for f in cube.facts), schema_required={"seller": frozenset({"Supplier ID"})})
    return r


ask("flt_schema_required", request("sales", FLAGS, where("Supplier ID", "=", 7)), SQL.format("l_suppkey = 7"), registry=_required, schema="seller")


@query("flt_druid_expand_days", SQL.format("CAST(l_shipdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-20'"))
def _(spark, sf_dir):
    d = folder(spark, sf_dir)("lineitem").where(expanded_days(F.date_format("l_shipdate", "yyyyMMdd"), "1997-03-01", "1997-03-20", "yyyyMMdd"))
    return d.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.count(F.lit(1)).alias("lines"))


@query("flt_js", EVENTS.format("length(event_type) % 2 = 1"))
def _(spark, sf_dir):
    """A function as a filter: its native translation over the column."""
    from ..cubes.trade import trade_engine

    e = trade_engine(spark, sf_dir)
    from ..request import from_json

    asked = from_json(request("activity", KINDS))
    return e.frame(asked.with_(filters=(Filter("JavaScript", "Kind", fn=lambda c: F.length(c) % 2 == 1),)))


def _guard(name: str, body: dict, part: str) -> None:
    """Requests that are refused; the answer is the message's kind."""

    @query(name, f"SELECT '{name}' AS guard, TRUE AS refused")
    def _(spark, sf_dir):
        from ..cubes.trade import trade_engine

        try:
            trade_engine(spark, sf_dir).resolve(body)
            refused = False
        except ValueError as e:
            refused = part in str(e)
        return spark.range(1).select(F.lit(name).alias("guard"), F.lit(refused).alias("refused"))


_guard("flt_max_window", request("sales", FLAGS, day=where("Day", "Between", "1990-01-01", "2002-12-31")), "more than the 4000")
_guard("flt_max_lookback", request("sales", FLAGS, day=where("Day", "Between", "1968-01-01", "1968-12-31")), "days ago")
_guard("flt_future_date", request("sales", FLAGS, day=where("Day", "=", "2031-01-01")), "in the future")
_guard("flt_value_len", request("sales", FLAGS, where("Flag", "=", "RETURNED")), "longer than 5")
