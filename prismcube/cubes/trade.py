"""Cubes over the trade tables: `sales` on line items, `activity` on events, `branches` on a union view."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..model import Cube, DateType, DecType, DimCol, DimTable, FactCol, FactTable, IntType, PublicCol, PublicDim, Registry, StrType, TimestampType, union_view
from ..operators.filters import F_in, Filter
from ..operators.rollups import NOOP, Cardinality, Custom, Filtered, HyperUnique, RoundingSum, Theta, ThetaSetOp
from ..plans.select import RangeLookup
from ..sources import folder

TODAY = date(2024, 2, 15)
RETURN = StrType(mapping={"R": "Returned", "A": "Accepted", "N": "Open"}, mapping_default="Other")
#: Two codes share a label.
SETTLED = StrType(mapping={"R": "Settled", "A": "Settled", "N": "Pending"}, mapping_default="Other")
STATUS = StrType(mapping={"O": "Open", "F": "Filled", "P": "Partial"}, mapping_default="Unknown")
KIND = StrType(mapping={"view": "Passive", "click": "Active", "purchase": "Active", "signup": "Active"}, mapping_default="Other")


def _public(*names: str | tuple[str, str], **more) -> tuple[PublicCol, ...]:
    return tuple(PublicCol(n, n, **more) if isinstance(n, str) else PublicCol(n[0], n[1], **more) for n in names)


def dimensions() -> list[PublicDim]:
    region = DimTable("region", (DimCol("r_regionkey", IntType(), primary_key=True), DimCol("r_name")), level=1)
    nation = DimTable("nation", (DimCol("n_nationkey", IntType(), primary_key=True), DimCol("n_name"), DimCol("n_regionkey", IntType(), foreign_key="region")), level=2)
    customer = DimTable(
        "customer",
        (
            DimCol("c_custkey", IntType(), primary_key=True), DimCol("c_name", StrType(length=40), case_insensitive=True), DimCol("c_nationkey", IntType(), foreign_key="nation"),
            DimCol("c_acctbal", DecType()), DimCol("c_mktsegment"),
            DimCol("segment_class", StrType(), expr=lambda r: F.when(r("c_mktsegment").isin("BUILDING", "MACHINERY"), "Industry").otherwise("Consumer"), uses=("c_mktsegment",)),
        ), level=3,
    )
    supplier = DimTable("supplier", (DimCol("s_suppkey", IntType(), primary_key=True), DimCol("s_name"), DimCol("s_nationkey", IntType(), foreign_key="nation"), DimCol("s_acctbal", DecType())), level=3)
    orders = DimTable(
        "orders",
        (
            DimCol("o_orderkey", IntType(), primary_key=True), DimCol("o_custkey", IntType(), foreign_key="customer"), DimCol("o_orderstatus", STATUS),
            DimCol("o_totalprice", DecType()), DimCol("o_orderdate", DateType()), DimCol("o_orderpriority"),
        ), level=4, forced_filters=(Filter("Not In", "o_orderstatus", ("Partial",), overridable=True),),
    )
    part = DimTable("part", (DimCol("p_partkey", IntType(), primary_key=True), DimCol("p_name"), DimCol("p_brand"), DimCol("p_type"), DimCol("p_size", IntType()), DimCol("p_retailprice", DecType())), level=1)
    user = DimTable("user_state", (DimCol("user_id", IntType(), primary_key=True), DimCol("event_type", KIND), DimCol("ts", TimestampType()), DimCol("value", DecType())), level=1, table="events", snapshot_column="ts")
    return [
        PublicDim("region", region, _public(("Region ID", "r_regionkey"), ("Region", "r_name"))),
        PublicDim("nation", nation, _public(("Nation ID", "n_nationkey"), ("Nation", "n_name"), ("Region ID", "n_regionkey"))),
        PublicDim("customer", customer, _public(("Customer ID", "c_custkey"), ("Customer", "c_name"), ("Segment", "c_mktsegment"), ("Segment Class", "segment_class"), ("Balance", "c_acctbal"))),
        PublicDim("supplier", supplier, _public(("Supplier ID", "s_suppkey"), ("Supplier", "s_name"), ("Supplier Balance", "s_acctbal"))),
        PublicDim("orders", orders, _public(("Order ID", "o_orderkey"), ("Order Status", "o_orderstatus"), ("Order Date", "o_orderdate"), ("Priority", "o_orderpriority"), ("Order Price", "o_totalprice"))),
        PublicDim("part", part, _public(("Part ID", "p_partkey"), ("Part", "p_name"), ("Brand", "p_brand"), ("Type", "p_type"), ("Size", "p_size"))),
        PublicDim("user_state", user, _public(("User ID", "user_id"), ("Last Event", "event_type"))),
    ]


def _line_dims() -> tuple[DimCol, ...]:
    day = lambda r: F.to_date(F.col("l_shipdate"))
    return (
        DimCol("l_orderkey", IntType(), foreign_key="orders"), DimCol("l_partkey", IntType(), foreign_key="part"), DimCol("l_suppkey", IntType(), foreign_key="supplier"),
        DimCol("l_linenumber", IntType()), DimCol("l_returnflag", RETURN), DimCol("settled", SETTLED, source="l_returnflag"), DimCol("l_linestatus"), DimCol("flag", StrType(length=5), source="l_returnflag"),
        DimCol("day", DateType(), expr=day), DimCol("month", DateType(), expr=lambda r: F.trunc(F.to_date(F.col("l_shipdate")), "MM")),
        DimCol("week", DateType(), expr=lambda r: F.date_trunc("week", F.col("l_shipdate")).cast("date")), DimCol("year", StrType(), expr=lambda r: F.year(F.col("l_shipdate")).cast("string")),
        DimCol("size_class", StrType(), expr=lambda r: F.when(F.col("l_quantity") >= 40, "bulk").when(F.col("l_quantity") >= 10, "normal").otherwise("small")),
        DimCol("source", StrType(), const="web"), DimCol("orders_seen", IntType(), expr="count_distinct({l_orderkey})", aggregate=True, uses=("l_orderkey",)),
    )


def _line_metrics() -> tuple[FactCol, ...]:
    return (
        FactCol("quantity", IntType(), source="l_quantity"), FactCol("price", DecType(scale=2), source="l_extendedprice"), FactCol("discount", DecType(scale=4), source="l_discount"),
        FactCol("tax", DecType(scale=4), source="l_tax"), FactCol("max_price", DecType(), "max", source="l_extendedprice"), FactCol("min_price", DecType(), "min", source="l_extendedprice"),
        FactCol("avg_price", DecType(scale=6), "avg", source="l_extendedprice"), FactCol("lines", IntType(), "count"),
        FactCol("revenue", DecType(scale=4), "sum", expr="{l_extendedprice} * (1 - {l_discount})"),
        FactCol("unit_price", DecType(scale=6), NOOP, expr="{price} /- {quantity}", uses=("price", "quantity")), FactCol("unit_price_cents", DecType(scale=4), NOOP, expr="{unit_price} * 100", uses=("unit_price",)),
        FactCol("weighted_discount", DecType(scale=6), Custom("sum({l_discount} * {l_quantity}) /- sum({l_quantity})")),
        FactCol("discount_rate", DecType(scale=6, default=0.0, min=0.0, max=0.0515), NOOP, expr="sum({l_discount} * {l_extendedprice}) /- sum({l_extendedprice})"),
        FactCol("returned_quantity", IntType(), Filtered((F_in("flag", "R"),), "l_quantity")),
        FactCol("returned_final", IntType(), Filtered.listed((F_in("flag", "R"), F_in("l_linestatus", "F")), "l_quantity")),
        FactCol("parts", IntType(), "count_distinct", source="l_partkey"), FactCol("rounded_price", DecType(), RoundingSum(1), source="l_extendedprice"),
        FactCol("large_lines", IntType(), Custom("sum({is_large})"), uses=("is_large",)), FactCol("is_large", IntType(), "sum", expr=lambda r: F.when(F.col("l_quantity") > 25, 1).otherwise(0)),
        FactCol("part_suppliers", IntType(), Cardinality(("l_partkey", "l_suppkey"), by_row=True, exact=True)), FactCol("about_parts", IntType(), Cardinality(("l_partkey",))),
    )


def sales_fact(**more) -> FactTable:
    dims, metrics = _line_dims(), _line_metrics()
    metrics = tuple(m if m.name != "large_lines" else FactCol("large_lines", IntType(), "sum", expr=lambda r: F.when(F.col("l_quantity") > 25, 1).otherwise(0)) for m in metrics if m.name != "is_large")
    return FactTable("lineitem", dims, metrics, time_column="l_shipdate", cost_multiplier=RangeLookup([(0, 1 << 60, 1)]), default_rows=1000, **more)


SALES_DIMS = (
    ("Order ID", "l_orderkey"), ("Part ID", "l_partkey"), ("Supplier ID", "l_suppkey"), ("Line", "l_linenumber"), ("Return Flag", "l_returnflag"), ("Settled", "settled"), ("Line Status", "l_linestatus"),
    ("Flag", "flag"), ("Day", "day"), ("Month", "month"), ("Week", "week"), ("Year", "year"), ("Size Class", "size_class"), ("Source", "source"), ("Orders Seen", "orders_seen"), ("Return Code", "flag"),
)
SALES_METRICS = (
    ("Quantity", "quantity"), ("Price", "price"), ("Discount", "discount"), ("Tax", "tax"), ("Max Price", "max_price"), ("Min Price", "min_price"), ("Avg Price", "avg_price"), ("Lines", "lines"),
    ("Revenue", "revenue"), ("Unit Price", "unit_price"), ("Unit Price Cents", "unit_price_cents"), ("Weighted Discount", "weighted_discount"), ("Discount Rate", "discount_rate"),
    ("Returned Quantity", "returned_quantity"), ("Returned Final", "returned_final"), ("Parts", "parts"), ("Rounded Price", "rounded_price"), ("Large Lines", "large_lines"),
    ("Part Suppliers", "part_suppliers"), ("About Parts", "about_parts"),
)


def sales_cube() -> Cube:
    return Cube("sales", (sales_fact(),), _public(*SALES_DIMS), _public(*SALES_METRICS), max_window={("sync", "daily"): 4000, ("async", "daily"): 8000}, max_lookback={("sync", "daily"): 20000})


def activity_fact() -> FactTable:
    dims = (
        DimCol("user_id", IntType(), foreign_key="user_state"), DimCol("event_type", KIND), DimCol("kind", StrType(length=10), source="event_type", case_insensitive=True), DimCol("props"),
        DimCol("event_id", IntType()), DimCol("user_twin", IntType(), source="user_id"), DimCol("at", TimestampType(), source="ts"),
        DimCol("day", DateType(), expr=lambda r: F.to_date("ts")), DimCol("hour", StrType(), expr=lambda r: F.date_format("ts", "HH")), DimCol("minute", StrType(), expr=lambda r: F.date_format("ts", "mm")),
    )
    metrics = (
        FactCol("value", DecType(scale=2)), FactCol("events", IntType(), "count"), FactCol("max_value", DecType(), "max", source="value"),
        FactCol("purchase_value", DecType(scale=2, default=0.0), Filtered((F_in("kind", "purchase"),), "value")), FactCol("clicks", IntType(), Filtered((F_in("kind", "click"),), "event_id", "count")),
        FactCol("click_rate", DecType(scale=6), NOOP, expr="{clicks} /- {events}", uses=("clicks", "events")),
        FactCol("users", IntType(), Theta("user_id")), FactCol("users_hll", IntType(), HyperUnique("user_id")), FactCol("users_exact", IntType(), "count_distinct", source="user_id"),
        FactCol("both", IntType(), ThetaSetOp("INTERSECT", (Theta("user_id", where=(F_in("kind", "purchase"),)), Theta("user_id", where=(F_in("kind", "error"),))))),
        FactCol("either", IntType(), ThetaSetOp("UNION", (Theta("user_id", where=(F_in("kind", "purchase"),)), Theta("user_id", where=(F_in("kind", "error"),))))),
        FactCol("only_first", IntType(), ThetaSetOp("NOT", (Theta("user_id", where=(F_in("kind", "purchase"),)), Theta("user_id", where=(F_in("kind", "error"),))))),
    )
    return FactTable("events", dims, metrics, grain="minute", time_column="ts", default_rows=500)


def activity_cube() -> Cube:
    dims = _public(("User ID", "user_id"), ("Event Type", "event_type"), ("Kind", "kind"), ("Props", "props"), ("Event ID", "event_id"), ("User Twin", "user_twin"), ("At", "at"), ("Day", "day"), ("Hour", "hour"), ("Minute", "minute"))
    names = (("Value", "value"), ("Events", "events"), ("Max Value", "max_value"), ("Purchase Value", "purchase_value"), ("Clicks", "clicks"), ("Click Rate", "click_rate"), ("Users", "users"), ("Users HLL", "users_hll"), ("Users Exact", "users_exact"), ("Both", "both"), ("Either", "either"), ("Only First", "only_first"))
    return Cube("activity", (activity_fact(),), dims, _public(*names))


def branch_cube() -> Cube:
    """A union view over two filtered branches of line items, each with a constant."""
    day = lambda r: F.to_date(F.col("l_shipdate"))
    dims = (DimCol("l_suppkey", IntType(), foreign_key="supplier"), DimCol("l_linestatus"), DimCol("day", DateType(), expr=day), DimCol("year", StrType(), expr=lambda r: F.year(r("day")).cast("string"), uses=("day",)))
    metrics = (FactCol("quantity", IntType(), source="l_quantity"), FactCol("price", DecType(scale=2), source="l_extendedprice"), FactCol("unit_price", DecType(scale=6), NOOP, expr="{price} /- {quantity}", uses=("price", "quantity")))
    one = FactTable("lines_returned", dims, metrics, table="lines_returned", time_column="l_shipdate")
    two = FactTable("lines_kept", dims, metrics, table="lines_kept", time_column="l_shipdate")
    own = FactTable("lines", tuple(d for d in dims if d.name not in ("day", "year")) + (DimCol("day", DateType()), DimCol("year", StrType(), expr=lambda r: F.year(r("day")).cast("string"), uses=("day",))), metrics)
    view = union_view("lines", ((one, {"channel": "returns"}), (two, {"channel": "sales"})))
    view = type(view)(**{**view.__dict__, "dims": (*own.dims, DimCol("channel")), "time_column": None})
    return Cube("branches", (view,), _public(("Supplier ID", "l_suppkey"), ("Line Status", "l_linestatus"), ("Day", "day"), ("Year", "year"), ("Channel", "channel")), _public(("Quantity", "quantity"), ("Price", "price"), ("Unit Price", "unit_price")))


def registry() -> Registry:
    return Registry().add(*dimensions(), sales_cube(), activity_cube(), branch_cube())


def trade_engine(spark: SparkSession, path: str, **more) -> Engine:
    """Tables of a folder; the two branches are filters on line items."""
    read = folder(spark, path)

    def source(name: str):
        if name == "lines_returned":
            return read("lineitem").where("l_returnflag = 'R'")
        if name == "lines_kept":
            return read("lineitem").where("l_returnflag <> 'R'")
        return read(name)

    return Engine(spark, more.pop("registry", None) or registry(), source, **{"today": lambda: TODAY, **more})
