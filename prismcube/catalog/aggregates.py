"""Rollups and groupings."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import E, L, ask, query, request, where

FLAG = "CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'Open' ELSE 'Other' END AS flag"
LINES = f"FROM lineitem WHERE {L} GROUP BY 1"


def metric(name: str, fields: dict[str, str], sql: str) -> None:
    ask(name, request("sales", {"flag": "Return Flag", **fields}), f"SELECT {FLAG}, {sql} {LINES}")


metric("agg_sum", {"quantity": "Quantity", "price": "Price", "revenue": "Revenue"}, "CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue")
metric("agg_max", {"max_price": "Max Price"}, "max(l_extendedprice) AS max_price")
metric("agg_min", {"min_price": "Min Price"}, "min(l_extendedprice) AS min_price")
metric("agg_avg", {"avg_price": "Avg Price"}, "round(avg(l_extendedprice), 6) AS avg_price")
metric("agg_count", {"lines": "Lines"}, "count(*) AS lines")
metric("agg_noop", {"unit_price": "Unit Price", "cents": "Unit Price Cents"}, "round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price, round(sum(l_extendedprice) / sum(l_quantity) * 100, 4) AS cents")
metric("agg_custom", {"weighted_discount": "Weighted Discount"}, "round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_discount")
metric("agg_filtered", {"returned": "Returned Quantity"}, "CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS returned")
metric("agg_filtered_list", {"returned": "Returned Final"}, "CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS BIGINT) AS returned")
metric("agg_count_distinct", {"parts": "Parts"}, "count(DISTINCT l_partkey) AS parts")
metric("agg_cardinality", {"pairs": "Part Suppliers"}, "count(DISTINCT (l_partkey, l_suppkey)) AS pairs")
metric("agg_rounding_sum", {"price": "Rounded Price"}, "round(sum(l_extendedprice), 1) AS price")
metric("agg_default_clamp", {"rate": "Discount Rate"}, "CASE WHEN sum(l_discount * l_extendedprice) / sum(l_extendedprice) BETWEEN 0 AND 0.0515 THEN round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) ELSE 0.0 END AS rate")
metric("agg_sum_of_case", {"large": "Large Lines"}, "CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large")
metric("agg_dim_aggregate", {"orders_seen": "Orders Seen", "lines": "Lines"}, "count(DISTINCT l_orderkey) AS orders_seen, count(*) AS lines")
ask("agg_cardinality_approx", request("sales", {"flag": "Return Flag", "about": "About Parts"}))
ask(
    "agg_count_distinct_outer", request("sales", {"region": "Region", "parts": "Parts"}),
    f"SELECT r_name AS region, count(DISTINCT l_partkey) AS parts FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE {L} GROUP BY 1",
)
ask("agg_group_by_static_map", request("sales", {"settled": "Settled", "lines": "Lines"}), f"SELECT CASE WHEN l_returnflag IN ('R', 'A') THEN 'Settled' WHEN l_returnflag = 'N' THEN 'Pending' ELSE 'Other' END AS settled, count(*) AS lines {LINES}")
ask("agg_group_by_derived_dim", request("sales", {"size_class": "Size Class", "lines": "Lines"}), f"SELECT CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 10 THEN 'normal' ELSE 'small' END AS size_class, count(*) AS lines {LINES}")
ask("agg_timeseries", request("sales", {"day": "Day", "quantity": "Quantity"}), f"SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) AS BIGINT) AS quantity {LINES}")
ask("agg_timeseries_month", request("sales", {"month": "Month", "quantity": "Quantity"}), f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(l_quantity) AS BIGINT) AS quantity {LINES}")
ask("agg_timeseries_week", request("sales", {"week": "Week", "quantity": "Quantity"}), f"SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(sum(l_quantity) AS BIGINT) AS quantity {LINES}")
ask("agg_timeseries_year", request("sales", {"year": "Year", "quantity": "Quantity"}), f"SELECT CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(sum(l_quantity) AS BIGINT) AS quantity {LINES}")
ask("agg_topn", request("sales", {"part_id": "Part ID", "price": "Price"}, sort=[("price", "DESC")], rowsPerPage=20), f"SELECT l_partkey AS part_id, round(sum(l_extendedprice), 2) AS price {LINES} ORDER BY 2 DESC LIMIT 20")
ask("agg_row_count", request("sales", {"supplier_id": "Supplier ID", "flag": "Flag", "quantity": "Quantity"}, queryType="rowcount"), f'SELECT count(*) AS "TOTALROWS" FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE {L})')
ask("agg_dim_distinct", request("sales", {"segment": "Segment", "nation": "Nation"}, additionalParameters={"Distinct": True}), "SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
ask("agg_total_metrics", request("sales", {"quantity": "Quantity", "unit_price": "Unit Price"}), f"SELECT CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price FROM lineitem WHERE {L}")
ask("agg_union_view", request("branches", {"year": "Year", "quantity": "Quantity", "unit_price": "Unit Price"}), f"SELECT CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price {LINES}")

@query("agg_outer_groupby", f"SELECT c_mktsegment AS segment, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price, round(avg(l_extendedprice), 6) AS avg_price, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE {L} AND o_orderstatus <> 'P' AND c_acctbal > 0 GROUP BY 1")
def _(spark, sf_dir):
    from ..cubes.trade import trade_engine

    return trade_engine(spark, sf_dir).frame(request("sales", {"segment": "Segment", "unit_price": "Unit Price", "avg_price": "Avg Price", "lines": "Lines"}, where("Balance", ">", 0)))


DAYS = f"FROM events WHERE {E} GROUP BY 1"
ask("agg_theta_sketch", request("activity", {"day": "Day", "users": "Users"}), f"SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users {DAYS}")
P, X = "list(DISTINCT user_id) FILTER (WHERE event_type = 'purchase')", "list(DISTINCT user_id) FILTER (WHERE event_type = 'error')"
ask(
    "agg_theta_setop", request("activity", {"day": "Day", "both": "Both", "either": "Either", "only_first": "Only First"}),
    f"SELECT day, CAST(len(list_intersect(p, x)) AS BIGINT) AS both, CAST(len(list_distinct(list_concat(p, x))) AS BIGINT) AS either, CAST(len(p) - len(list_intersect(p, x)) AS BIGINT) AS only_first FROM (SELECT CAST(ts AS DATE) AS day, coalesce({P}, []) AS p, coalesce({X}, []) AS x {DAYS})",
)
ask("agg_hll_unique", request("activity", {"day": "Day", "users": "Users HLL"}))
ask("agg_hll_unique_exact", request("activity", {"day": "Day", "users": "Users Exact"}), f"SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users {DAYS}")
ask("agg_derived_rate", request("activity", {"kind": "Event Type", "rate": "Click Rate", "purchases": "Purchase Value"}), f"SELECT CASE WHEN event_type = 'view' THEN 'Passive' WHEN event_type IN ('click', 'purchase', 'signup') THEN 'Active' ELSE 'Other' END AS kind, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS rate, coalesce(round(sum(value) FILTER (WHERE event_type = 'purchase'), 2), 0.0) AS purchases {DAYS}")


@query("agg_druid_custom", f"SELECT CAST(ts AS DATE) AS day, round(count(*) FILTER (WHERE event_type = 'click') * 100 / count(*), 4) AS pct {DAYS}")
def _(spark, sf_dir):
    """A rollup that is an expression over other aggregates."""
    from dataclasses import replace

    from ..cubes.trade import registry, trade_engine
    from ..model import DecType, FactCol, PublicCol
    from ..operators.rollups import Custom

    r = registry()
    cube = r.cubes["activity", 0]
    pct = FactCol("click_pct", DecType(scale=4), Custom("{clicks} * 100 /- {events}"), uses=("clicks", "events"))
    r.cubes["activity", 0] = replace(cube, facts=tuple(replace(f, metrics=(*f.metrics, pct)) for f in cube.facts), metrics=(*cube.metrics, PublicCol("Click Pct", "click_pct")))
    return trade_engine(spark, sf_dir, registry=r).frame(request("activity", {"day": "Day", "pct": "Click Pct"}))
