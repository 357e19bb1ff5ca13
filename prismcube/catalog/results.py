"""Projection, sorting, paging, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cubes.trade import trade_engine
from ..sources import folder
from . import E, L, ask, query, request, where

FLAG = "CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'Open' ELSE 'Other' END"
Q = "CAST(sum(l_quantity) AS BIGINT) AS quantity"
ask("flagship", request("sales", {"nation": "Nation", "revenue": "Revenue", "unit_price": "Unit Price"}, where("Region", "In", "ASIA", "EUROPE"), sort=[("revenue", "DESC")], rowsPerPage=10), f"SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {L} AND r_name IN ('ASIA', 'EUROPE') GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
ask("prj_alias", request("sales", {"state": "Line Status", "items": "Quantity"}), f"SELECT l_linestatus AS state, CAST(sum(l_quantity) AS BIGINT) AS items FROM lineitem WHERE {L} GROUP BY 1")
ask("prj_dup_alias", request("sales", {"flag": "Flag", "code": "Return Code", "label": "Return Flag", "quantity": "Quantity"}), f"SELECT l_returnflag AS flag, l_returnflag AS code, {FLAG} AS label, {Q} FROM lineitem WHERE {L} GROUP BY 1")
ask("prj_const", request("sales", {"flag": "Flag", "channel": ("Channel", "online"), "source": "Source", "quantity": "Quantity"}), f"SELECT l_returnflag AS flag, 'online' AS channel, 'web' AS source, {Q} FROM lineitem WHERE {L} GROUP BY 1")
ask("prj_distinct", request("sales", {"region": "Region", "segment": "Segment"}, additionalParameters={"Distinct": True}), "SELECT DISTINCT r_name AS region, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
SUPPLIERS = f"SELECT l_suppkey AS supplier_id, {Q} FROM lineitem WHERE {L} GROUP BY 1"
BY = {"supplier_id": "Supplier ID", "quantity": "Quantity"}
ask("sort_metric", request("sales", BY, sort=[("quantity", "DESC"), ("supplier_id", "ASC")], rowsPerPage=15), f"{SUPPLIERS} ORDER BY 2 DESC, 1 LIMIT 15")
ask("sort_dim", request("sales", BY, sort=[("supplier_id", "DESC")], rowsPerPage=15), f"{SUPPLIERS} ORDER BY 1 DESC LIMIT 15")
ask("sort_multi", request("sales", {"flag": "Flag", **BY}, sort=[("flag", "DESC"), ("quantity", "ASC"), ("supplier_id", "ASC")], rowsPerPage=25), f"SELECT l_returnflag AS flag, l_suppkey AS supplier_id, {Q} FROM lineitem WHERE {L} GROUP BY 1, 2 ORDER BY 1 DESC, 3, 2 LIMIT 25")
ask("sort_nulls_last", request("sales", {"order_id": "Order ID", "priority": "Priority", "lines": "Lines"}, sort=[("priority", "ASC"), ("order_id", "ASC")], paginationStartIndex=8200, rowsPerPage=50), f"SELECT l_orderkey AS order_id, o_orderpriority AS priority, count(*) AS lines FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey WHERE {L} GROUP BY 1, 2 ORDER BY 2 ASC NULLS LAST, 1 LIMIT 50 OFFSET 8200")
ask("sort_default_pk", request("sales", {"customer_id": "Customer ID", "customer": "Customer"}, rowsPerPage=9, paginationStartIndex=3), "SELECT c_custkey AS customer_id, c_name AS customer FROM customer ORDER BY 1 LIMIT 9 OFFSET 3")
ask("sort_const_skipped", request("sales", {"supplier_id": "Supplier ID", "kind": ("Kind", "x"), "quantity": "Quantity"}, sort=[("kind", "ASC"), ("quantity", "ASC"), ("supplier_id", "ASC")], rowsPerPage=5), f"SELECT l_suppkey AS supplier_id, 'x' AS kind, {Q} FROM lineitem WHERE {L} GROUP BY 1 ORDER BY 3, 1 LIMIT 5")
ask("limit_page", request("sales", BY, sort=[("quantity", "DESC"), ("supplier_id", "ASC")], paginationStartIndex=30, rowsPerPage=10), f"{SUPPLIERS} ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 30")
ask("limit_topn", request("sales", {"part_id": "Part ID", "max_price": "Max Price"}, sort=[("max_price", "DESC"), ("part_id", "ASC")], rowsPerPage=12), f"SELECT l_partkey AS part_id, max(l_extendedprice) AS max_price FROM lineitem WHERE {L} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
ask("win_total_rows", request("sales", {"customer_id": "Customer ID", "segment": "Segment"}, where("Balance", ">", 9000), includeRowCount=True), 'SELECT c_custkey AS customer_id, c_mktsegment AS segment, count(*) OVER () AS "TOTALROWS" FROM customer WHERE c_acctbal > 9000')
ask("win_grand_count_fact", request("sales", BY, where("Quantity", ">", 15500), includeRowCount=True, sort=[("quantity", "DESC"), ("supplier_id", "ASC")], rowsPerPage=4), f'SELECT *, count(*) OVER () AS "TOTALROWS" FROM ({SUPPLIERS} HAVING sum(l_quantity) > 15500) ORDER BY 2 DESC, 1 LIMIT 4')


ask("win_row_number", request("sales", BY, sort=[("quantity", "DESC"), ("supplier_id", "ASC")], paginationStartIndex=20, rowsPerPage=10, additionalParameters={"RowNumber": True}), f'SELECT * FROM (SELECT *, row_number() OVER (ORDER BY quantity DESC, supplier_id) AS "ROWNUM" FROM ({SUPPLIERS})) WHERE "ROWNUM" BETWEEN 21 AND 30')


@query("win_row_number_by_group", f"SELECT row_number() OVER (PARTITION BY flag ORDER BY quantity DESC, supplier_id) AS rank, * FROM (SELECT l_returnflag AS flag, l_suppkey AS supplier_id, {Q} FROM lineitem WHERE {L} GROUP BY 1, 2) QUALIFY rank <= 5")
def _(spark, sf_dir):
    """Rows numbered within a group; the limit on them is pushed below the exchange."""
    from pyspark.sql import Window

    out = trade_engine(spark, sf_dir).frame(request("sales", {"flag": "Flag", **BY}))
    w = Window.partitionBy("flag").orderBy(F.desc("quantity"), "supplier_id")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5")


ask(
    "win_snapshot_latest", request("activity", {"user_id": "User ID", "last_event": "Last Event", "events": "Events"}),
    f"SELECT f.user_id, CASE WHEN d.event_type IS NULL THEN NULL WHEN d.event_type = 'view' THEN 'Passive' WHEN d.event_type IN ('click', 'purchase', 'signup') THEN 'Active' ELSE 'Other' END AS last_event, f.events FROM (SELECT user_id, count(*) AS events FROM events WHERE {E} GROUP BY 1) f LEFT JOIN (SELECT * FROM events QUALIFY max(ts) OVER (PARTITION BY user_id) = ts) d ON f.user_id = d.user_id",
)


@query("set_union_all", "SELECT s_suppkey AS id, CAST(1 AS INTEGER) AS part FROM supplier WHERE s_suppkey IN (1, 2, 3) UNION ALL SELECT s_suppkey, 2 FROM supplier WHERE s_suppkey NOT IN (1, 2, 3) AND s_acctbal > 3000")
def _(spark, sf_dir):
    s = folder(spark, sf_dir)("supplier")
    keys = F.col("s_suppkey").isin(1, 2, 3)
    first = s.where(keys).select(F.col("s_suppkey").alias("id"), F.lit(1).alias("part"))
    return first.unionByName(s.where(~keys & (F.col("s_acctbal") > 3000)).select(F.col("s_suppkey").alias("id"), F.lit(2).alias("part")))


ask("set_union_view", request("branches", {"channel": "Channel", "supplier": "Supplier", "quantity": "Quantity"}), f"SELECT CASE WHEN l_returnflag = 'R' THEN 'returns' ELSE 'sales' END AS channel, s_name AS supplier, {Q} FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE {L} GROUP BY 1, 2")
ask("set_union_view_constant", request("branches", {"status": "Line Status", "quantity": "Quantity"}, where("Channel", "=", "returns")), f"SELECT l_linestatus AS status, {Q} FROM lineitem WHERE {L} AND l_returnflag = 'R' GROUP BY 1")
