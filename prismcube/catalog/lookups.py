"""Lookups declared as columns of the sales cube; parts of more than size 40 are left out of the namespace, so that there are misses."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cubes.trade import trade_engine
from ..functions import lookup as k
from ..model import DimCol, Lookup, StrType
from ..sources import folder
from . import L, query, register, where
from .functions import asked

FROM = f"FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) p ON l_partkey = p_partkey WHERE {L}"


def spaces(spark, sf_dir) -> dict[str, k.Namespace]:
    part = folder(spark, sf_dir)("part").where("p_size <= 40").withColumn("added", F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), "yyyyMMdd"))
    part = part.withColumn("stamp", F.lit(1600000000000) + F.col("p_size") * 3600000)
    return {"part": k.Namespace("part", part, "p_partkey")}


def column(value: str | None = "p_brand", **more: Any) -> DimCol:
    return DimCol("", StrType(), lookup=Lookup("part", "l_partkey", value, **more), uses=("l_partkey",))


def look(name: str, col: DimCol, sql: str, *filters: dict, **more) -> None:
    """By part, with the number of lines."""
    asked(name, "sales", {"v": col}, {"id": "Part ID", "lines": "Lines"}, f"SELECT l_partkey AS id, count(*) AS lines, {sql} AS v {FROM} GROUP BY 1", *filters, namespaces=spaces, **more)


look("lkp_basic", column(), "any_value(p_brand)")
look("lkp_retain", column(retain=True), "coalesce(any_value(p_brand), CAST(l_partkey AS VARCHAR))")
look("lkp_empty_override", column(missing="none"), "coalesce(any_value(p_brand), 'none')")
look("lkp_decode", column("p_type", then="decode({value}, 'PROMO', 'promotion', 'SMALL', 'little', 'other')"), "CASE any_value(p_type) WHEN 'PROMO' THEN 'promotion' WHEN 'SMALL' THEN 'little' ELSE 'other' END")
look("lkp_decode_retain", column("p_type", then="decode_retain({value}, 'PROMO', 'promotion')"), "CASE any_value(p_type) WHEN 'PROMO' THEN 'promotion' ELSE any_value(p_type) END")
look("lkp_decode_other", column(None, expr="decode({p_type}, 'PROMO', {p_name}, {p_brand})"), "CASE WHEN any_value(p_type) = 'PROMO' THEN any_value(p_name) ELSE any_value(p_brand) END")
look("lkp_decode_other_repl", column(None, expr="decode({p_type}, 'PROMO', {p_name}, {p_brand})", missing="?"), "coalesce(CASE WHEN any_value(p_type) = 'PROMO' THEN any_value(p_name) ELSE any_value(p_brand) END, '?')")
look("lkp_timefmt", column("added", then="interval_text({value}, 'yyyyMMdd', 'dd/MM/yyyy')"), "strftime(DATE '2020-01-01' + any_value(p_size), '%d/%m/%Y')")
STAMP = column(None, expr="time_format(timestamp_millis({stamp}), 'yyyy-MM-dd HH:mm', '<TimeZone|UTC>')", missing="never")
look("lkp_timestamp", STAMP, "coalesce(strftime(make_timestamp((1600000000000 + CAST(any_value(p_size) AS BIGINT) * 3600000) * 1000), '%Y-%m-%d %H:%M'), 'never')")
look("lkp_override_map", column(keys=((5, "five"),)), "CASE WHEN l_partkey = 5 THEN 'five' ELSE any_value(p_brand) END")
look("lkp_override_values", column(values=(("Brand#1", "first"),)), "CASE WHEN any_value(p_brand) = 'Brand#1' THEN 'first' ELSE any_value(p_brand) END")
look("join_lookup", column("p_size"), "CAST(any_value(p_size) AS VARCHAR)")
BRAND = "CASE WHEN p_brand = 'Brand#1' THEN 'one' ELSE 'other' END"
#: The value is grouped by, and not the key: groups by the key, looked up, filtered, and grouped again.
asked("lkp_group", "sales", {"v": column()}, {"quantity": "Quantity", "unit_price": "Unit Price"}, f"SELECT p_brand AS v, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price {FROM} GROUP BY 1", namespaces=spaces)
asked("lkp_group_distinct", "sales", {"v": column()}, {"parts": "Parts"}, f"SELECT p_brand AS v, count(DISTINCT l_partkey) AS parts {FROM} GROUP BY 1", namespaces=spaces)
asked("lkp_joined", "sales", {"v": column()}, {"supplier": "Supplier", "lines": "Lines"}, f"SELECT p_brand AS v, s_name AS supplier, count(*) AS lines FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) p ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE {L} GROUP BY 1, 2", namespaces=spaces)
asked("lkp_scan", "sales", {"v": column()}, {"order_id": "Order ID", "line": "Line"}, f"SELECT l_orderkey AS order_id, l_linenumber AS line, p_brand AS v {FROM}", namespaces=spaces, queryType="scan")
asked("agg_nested_groupby", "sales", {"type": column("p_type"), "class": column("p_brand", then="decode({value}, 'Brand#1', 'one', 'other')")}, {"quantity": "Quantity"}, f"SELECT p_type AS type, {BRAND} AS class, CAST(sum(l_quantity) AS BIGINT) AS quantity {FROM} AND p_type <> 'PROMO' GROUP BY 1, 2", where("type", "<>", "PROMO"), namespaces=spaces)
asked("flt_lookup_dim", "sales", {"v": column("p_type"), "size": column("p_size")}, {"flag": "Flag", "quantity": "Quantity"}, f"SELECT p_type AS v, CAST(p_size AS VARCHAR) AS size, l_returnflag AS flag, CAST(sum(l_quantity) AS BIGINT) AS quantity {FROM} AND p_type IN ('PROMO', 'SMALL') AND l_returnflag = 'R' GROUP BY 1, 2, 3", where("v", "In", "PROMO", "SMALL"), where("Flag", "=", "R"), namespaces=spaces)
#: A dimension's column can be looked up as well.
asked(
    "lkp_of_dimension", "customer", {"v": DimCol("", StrType(), lookup=Lookup("nations", "c_nationkey", "n_name", missing="unknown"), uses=("c_nationkey",))}, {"id": "Customer ID"},
    "SELECT c_custkey AS id, coalesce(n_name, 'unknown') AS v FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n ON c_nationkey = n_nationkey WHERE coalesce(n_name, 'unknown') <> 'NATION_3'", where("v", "<>", "NATION_3"),
    namespaces=lambda spark, sf_dir: {"nations": k.Namespace("nations", folder(spark, sf_dir)("nation").where("n_regionkey <> 1"), "n_nationkey")},
)
SAID = f"SELECT l_partkey AS id, count(*) AS lines, CASE WHEN any_value(p_type) IS NULL THEN 'NA' WHEN any_value(p_type) = 'PROMO' THEN 'P' WHEN any_value(p_type) = 'SMALL' THEN 'S' ELSE any_value(p_type) END AS v {FROM} GROUP BY 1"


@query("lkp_sql_fn", SAID)
def _(spark, sf_dir) -> DataFrame:
    """As a function of the SQL dialect."""
    text = "SELECT \"Part ID\" AS id, \"Lines\" AS lines, LOOKUP(\"Part ID\", 'part', 'p_type', 'NA', 'PROMO->P,SMALL->S') AS v FROM sales WHERE \"Day\" BETWEEN '1995-01-01' AND '2001-12-31'"
    return trade_engine(spark, sf_dir, namespaces=spaces(spark, sf_dir)).sql(text)


@query("lkp_request", SAID)
def _(spark, sf_dir) -> DataFrame:
    """In a JSON request."""
    body = {
        "cube": "sales", "rowsPerPage": -1, "filterExpressions": [{"field": "Day", "operator": "Between", "from": "1995-01-01", "to": "2001-12-31"}],
        "selectFields": [{"field": "Part ID", "alias": "id"}, {"field": "Lines", "alias": "lines"}, {"field": "Part ID", "alias": "v", "lookup": {"namespace": "part", "column": "p_type", "missing": "NA", "values": {"PROMO": "P", "SMALL": "S"}}}],
    }
    return trade_engine(spark, sf_dir, namespaces=spaces(spark, sf_dir)).frame(body)


def _introspect(spark, sf_dir) -> DataFrame:
    part = folder(spark, sf_dir)("part").select("p_partkey", "p_brand")
    return k.Namespace("part", part, "p_partkey").introspect("entries")


register("lkp_introspect", _introspect, "SELECT p_partkey, p_brand FROM part")
