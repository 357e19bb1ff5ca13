"""Joins."""

from __future__ import annotations

from . import L, ask, request, where

Q = "CAST(sum(l_quantity) AS BIGINT) AS quantity"
O = "(SELECT * FROM orders WHERE o_orderstatus <> 'P')"  # noqa: E741
STATUS = "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' WHEN 'P' THEN 'Partial' WHEN NULL THEN NULL ELSE CASE WHEN o_orderstatus IS NULL THEN NULL ELSE 'Unknown' END END"

ask(
    "join_fact_left_dim", request("sales", {"order_id": "Order ID", "priority": "Priority", "quantity": "Quantity"}),
    f"SELECT l_orderkey AS order_id, o_orderpriority AS priority, {Q} FROM lineitem LEFT JOIN {O} o ON l_orderkey = o_orderkey WHERE {L} GROUP BY 1, 2",
)
ask(
    "join_fact_inner_dim", request("sales", {"order_id": "Order ID", "priority": "Priority", "quantity": "Quantity"}, where("Priority", "In", "1-URGENT", "2-HIGH")),
    f"SELECT l_orderkey AS order_id, o_orderpriority AS priority, {Q} FROM lineitem JOIN {O} o ON l_orderkey = o_orderkey WHERE {L} AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2",
)
ask(
    "join_dim_right",
    request("sales", {"part_id_": "Brand", "size": "Size", "quantity": "Quantity"}, where("Line", "=", 7), day=where("Day", "Between", "1996-01-01", "1996-02-28"), forceDimensionDriven=True),
    "SELECT p_brand AS part_id_, CAST(p_size AS INTEGER) AS size, CAST(sum(q) AS BIGINT) AS quantity FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-29' AND l_linenumber = 7 GROUP BY 1) f ON l_partkey = p_partkey GROUP BY 1, 2",
)
ask(
    "join_dim_right_key",
    request("sales", {"supplier": "Supplier", "balance": "Supplier Balance", "quantity": "Quantity"}, where("Line", "=", 1), day=where("Day", "=", "1996-03-01"), forceDimensionDriven=True),
    "SELECT s_name AS supplier, s_acctbal AS balance, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND CAST(l_shipdate AS DATE) = DATE '1996-03-01' AND l_linenumber = 1 GROUP BY 1, 2",
)
ask(
    "join_dim_inner_metric_filter", request("sales", {"supplier": "Supplier", "quantity": "Quantity"}, where("Quantity", ">", 7000), forceDimensionDriven=True),
    f"SELECT s_name AS supplier, {Q} FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE {L} GROUP BY 1 HAVING sum(l_quantity) > 7000",
)
ask(
    "join_dim_parent", request("sales", {"supplier": "Supplier", "nation": "Nation", "region": "Region", "quantity": "Quantity"}, forceDimensionDriven=True),
    f"SELECT s_name AS supplier, n_name AS nation, r_name AS region, CAST(sum(q) AS BIGINT) AS quantity FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE {L} GROUP BY 1) f ON l_suppkey = s_suppkey GROUP BY 1, 2, 3",
)
ask(
    "join_dim_parent_left", request("sales", {"supplier_id": "Supplier ID", "nation": "Nation", "region": "Region", "quantity": "Quantity"}),
    f"SELECT l_suppkey AS supplier_id, n_name AS nation, r_name AS region, {Q} FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE {L} GROUP BY 1, 2, 3",
)
ask(
    "join_snowflake", request("sales", {"customer": "Customer", "nation": "Nation", "region": "Region", "quantity": "Quantity"}, where("Segment", "=", "BUILDING")),
    f"SELECT c_name AS customer, n_name AS nation, r_name AS region, {Q} FROM lineitem JOIN {O} o ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {L} AND c_mktsegment = 'BUILDING' GROUP BY 1, 2, 3",
)
ask(
    "join_subquery_semi", request("sales", {"supplier_id": "Supplier ID", "quantity": "Quantity"}, where("Supplier Balance", ">", 5000)),
    f"SELECT l_suppkey AS supplier_id, {Q} FROM lineitem WHERE {L} AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1",
)
ask(
    "join_preagg", request("sales", {"supplier_id": "Supplier ID", "supplier": "Supplier", "avg_price": "Avg Price", "unit_price": "Unit Price"}),
    f"SELECT l_suppkey AS supplier_id, s_name AS supplier, round(avg(l_extendedprice), 6) AS avg_price, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE {L} GROUP BY 1, 2",
)
ask(
    "join_outer_groupby", request("sales", {"nation": "Nation", "avg_price": "Avg Price", "max_price": "Max Price", "lines": "Lines"}),
    f"SELECT n_name AS nation, round(avg(l_extendedprice), 6) AS avg_price, max(l_extendedprice) AS max_price, count(*) AS lines FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE {L} GROUP BY 1",
)
ask(
    "join_unrelated_dims", request("sales", {"brand": "Brand", "supplier_nation": "Nation", "priority": "Priority", "quantity": "Quantity"}),
    f"SELECT p_brand AS brand, n_name AS supplier_nation, o_orderpriority AS priority, {Q} FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN {O} o ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE {L} GROUP BY 1, 2, 3",
)
ask(
    "join_multi_engine_fact_first", request("sales", {"supplier_id": "Supplier ID", "supplier": "Supplier", "price": "Price"}, sort=[("price", "DESC"), ("supplier_id", "ASC")], rowsPerPage=7),
    f"SELECT supplier_id, s_name AS supplier, price FROM (SELECT l_suppkey AS supplier_id, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE {L} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7) f LEFT JOIN supplier ON supplier_id = s_suppkey",
)
ask(
    "join_multi_engine_dim_first", request("sales", {"part": "Part", "brand": "Brand", "size": "Size", "quantity": "Quantity"}, where("Size", "<", 10), forceDimensionDriven=True, sort=[("brand", "ASC"), ("size", "ASC"), ("part", "ASC")], paginationStartIndex=5, rowsPerPage=10),
    f"SELECT p_name AS part, p_brand AS brand, CAST(p_size AS INTEGER) AS size, CAST(sum(q) AS BIGINT) AS quantity FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE {L} GROUP BY 1) f ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1, 2, 3 ORDER BY 2, 3, 1 LIMIT 10 OFFSET 5",
)
ask(
    "join_multi_engine_dim_fact_ordered", request("sales", {"supplier": "Supplier", "quantity": "Quantity"}, where("Line", "=", 7), day=where("Day", "Between", "1996-01-01", "1996-01-31"), forceDimensionDriven=True, sort=[("quantity", "DESC"), ("supplier", "ASC")], paginationStartIndex=20, rowsPerPage=40),
    "SELECT s_name AS supplier, CAST(sum(q) AS BIGINT) AS quantity FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01' AND l_linenumber = 7 GROUP BY 1) f ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 40 OFFSET 20",
)


def _partitioned():
    """Customers and nations share a partition column."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from ..cubes.trade import registry
    from ..model import DimCol, IntType

    r = registry()
    for d, key in (("customer", "c_custkey"), ("nation", "n_nationkey")):
        own = DimCol("shard", IntType(), expr=lambda _, key=key: F.col(key) % 5, partition=True)
        r.dims[d] = replace(r.dims[d], table=replace(r.dims[d].table, columns=(*r.dims[d].table.columns, own)))
    return r


ask("join_partition_keys", request("sales", {"customer_id": "Customer ID", "nation": "Nation"}), "SELECT c_custkey AS customer_id, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 5 = n_nationkey % 5", registry=_partitioned)
