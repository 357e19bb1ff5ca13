"""Scans, sinks and metadata."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..cubes.trade import registry, trade_engine
from ..sources import folder, scratch
from . import L, ask, query, request

ask("src_fact", request("sales", {"flag": "Flag", "quantity": "Quantity"}), f"SELECT l_returnflag AS flag, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE {L} GROUP BY 1")
ask("src_scan", request("sales", {"order_id": "Order ID", "line": "Line", "flag": "Return Flag", "quantity": "Quantity"}, queryType="scan"), f"SELECT l_orderkey AS order_id, l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'Open' ELSE 'Other' END AS flag, l_quantity AS quantity FROM lineitem WHERE {L}")


@query("src_multi_ds", f"SELECT l_linestatus AS status, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE {L} GROUP BY 1")
def _(spark, sf_dir):
    """A fact of two tables, the lines that came back and the others."""
    from dataclasses import replace

    r = registry()
    cube = r.cubes["sales", 0]
    r.cubes["sales", 0] = replace(cube, facts=tuple(replace(f, table="lines_returned,lines_kept") for f in cube.facts))
    return trade_engine(spark, sf_dir, registry=r).frame(request("sales", {"status": "Line Status", "quantity": "Quantity"}))


ROWS = {"supplier_id": "Supplier ID", "flag": "Flag", "quantity": "Quantity"}
SAME = f"SELECT l_suppkey AS supplier_id, l_returnflag AS flag, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE {L} GROUP BY 1, 2"
ask("sink_rows", request("sales", ROWS), SAME)


@query("sink_csv", SAME)
def _(spark, sf_dir):
    """Written and read again."""
    from ..output import write_csv
    from ..sources import Location

    path = scratch(spark)
    write_csv(trade_engine(spark, sf_dir).frame(request("sales", ROWS)), path)
    return Location("csv", path, "supplier_id bigint, flag string, quantity bigint", {"header": "true"}).read(spark)


@query("sink_tsv", SAME)
def _(spark, sf_dir):
    from ..output import write_csv
    from ..sources import Location

    path = scratch(spark)
    write_csv(trade_engine(spark, sf_dir).frame(request("sales", ROWS)), path, separator="\t", header=False)
    return Location("tsv", path, "supplier_id bigint, flag string, quantity bigint").read(spark)


@query("sink_json", SAME)
def _(spark, sf_dir):
    from ..output import write_json
    from ..sources import Location

    path = scratch(spark)
    write_json(trade_engine(spark, sf_dir).frame(request("sales", ROWS)), path)
    return Location("json", path, "supplier_id bigint, flag string, quantity bigint").read(spark)


@query("sink_json_rows", f"SELECT '{{\"supplier_id\":' || supplier_id || ',\"flag\":\"' || flag || '\",\"quantity\":' || quantity || '}}' AS row FROM ({SAME})")
def _(spark, sf_dir):
    from ..output import json_rows

    return json_rows(trade_engine(spark, sf_dir).frame(request("sales", ROWS)))


@query("sink_concat_csv", f"SELECT supplier_id || ',' || flag || ',' || quantity AS line FROM ({SAME})")
def _(spark, sf_dir):
    from ..output import concatenated

    return concatenated(trade_engine(spark, sf_dir).frame(request("sales", ROWS)))


@query("sink_api_json", f"SELECT 'sales' AS cube, 'DIM,DIM,FACT' AS kinds, supplier_id, flag, quantity FROM ({SAME} ORDER BY 3 DESC, 1, 2 LIMIT 40)")
def _(spark, sf_dir):
    """The envelope's header beside its rows."""
    from ..output import envelope

    e = trade_engine(spark, sf_dir)
    r = e.resolve(request("sales", ROWS, sort=[("quantity", "DESC"), ("supplier_id", "ASC"), ("flag", "ASC")], rowsPerPage=40))
    out = json.loads("".join(envelope(r, e.planner.frame(r), debug=True)))
    head = (out["header"]["cube"], ",".join(f["fieldType"] for f in out["header"]["fields"]))
    return spark.createDataFrame([(*head, *row) for row in out["rows"]], "cube string, kinds string, supplier_id bigint, flag string, quantity bigint")


@query("meta_domain")
def _(spark, sf_dir):
    from ..metadata import domain_frame

    return domain_frame(spark, registry(), "sales")


@query("ddl_gen")
def _(spark, sf_dir):
    from ..metadata import ddl

    r = registry()
    tables = [r.cubes["sales", 0].facts[0], *(d.table for d in r.dims.values())]
    return spark.createDataFrame([(t.name, ddl(t)) for t in tables], "name string, ddl string")


@query("ddl_dump", "SELECT * FROM (VALUES ('region', CAST(1 AS BIGINT), CAST(2 AS BIGINT)), ('nation', 2, 3), ('customer', 3, 5), ('supplier', 3, 4), ('orders', 4, 6), ('part', 1, 6)) t(name, level, columns)")
def _(spark, sf_dir):
    """A model of the tables as they are: types from their schemas, levels from the depth of their foreign keys."""
    from ..metadata import dumped

    t = folder(spark, sf_dir)
    primary = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "part": "p_partkey"}
    keys = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}}
    made = dumped({n: t(n).schema for n in primary}, primary, keys)
    return spark.createDataFrame([(n, d.level, len(d.columns)) for n, d in made.items()], "name string, level bigint, columns bigint")
