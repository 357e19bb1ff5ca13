"""Curators, SQL, time zones, latest-wins state and the choice of tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from ..cubes.trade import registry, sales_fact, trade_engine
from ..sources import folder
from . import L, ask, query, register, request, where

Q = "CAST(sum(l_quantity) AS BIGINT) AS quantity"
NOW = where("Day", "Between", "1997-02-01", "1997-02-28")
SHIFTED = """SELECT *, CASE WHEN q - qp = 0 THEN 0.0 WHEN qp = 0 THEN 100.0 ELSE round((q - qp) / qp * 100, 2) END AS "quantity Pct Change" FROM (
SELECT supplier_id, flag, q AS quantity, CAST(coalesce(p, 0) AS BIGINT) AS "quantity Prev", CAST(q AS DOUBLE) AS q, CAST(coalesce(p, 0) AS DOUBLE) AS qp FROM
(SELECT l_suppkey AS supplier_id, l_returnflag AS flag, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-02-01' AND l_shipdate < TIMESTAMP '1997-03-01' GROUP BY 1, 2) a
LEFT JOIN (SELECT l_suppkey AS s, l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '{}' AND l_shipdate < TIMESTAMP '{}' GROUP BY 1, 2) b ON supplier_id = s AND flag = f)"""
KEYS = {"supplier_id": "Supplier ID", "flag": "Flag", "quantity": "Quantity"}


def curated(name: str, curator: str, body: dict, sql: str | None) -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        return trade_engine(spark, sf_dir).execute(body)[curator]


shift = lambda lo, hi: f"SELECT supplier_id, flag, quantity, \"quantity Prev\", \"quantity Pct Change\" FROM ({SHIFTED.format(lo, hi)})"
curated("cur_default", "default", request("sales", KEYS, curators={"default": {}}), f"SELECT l_suppkey AS supplier_id, l_returnflag AS flag, {Q} FROM lineitem WHERE {L} GROUP BY 1, 2")
curated("cur_timeshift", "timeshift", request("sales", KEYS, day=NOW, curators={"timeshift": {}}), shift("1997-01-04", "1997-02-01"))
curated("cur_timeshift_offset", "timeshift", request("sales", KEYS, day=NOW, curators={"timeshift": {"config": {"daysOffset": 7}}}), shift("1996-12-28", "1997-01-25"))
curated("join_api_side_timeshift", "timeshift", request("sales", KEYS, where("Line", "<", 4), day=NOW, curators={"timeshift": {}}), shift("1997-01-04", "1997-02-01").replace("GROUP BY", "AND l_linenumber < 4 GROUP BY"))
curated("cur_totalmetrics", "totalmetrics", request("sales", {**KEYS, "unit_price": "Unit Price"}, sort=[("quantity", "DESC")], curators={"totalmetrics": {}}), f"SELECT {Q}, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price FROM lineitem WHERE {L}")
curated("cur_rowcount", "rowcount", request("sales", {"customer_id": "Customer ID", "segment": "Segment"}, where("Balance", ">", 0), curators={"rowcount": {}}, rowsPerPage=5), 'SELECT count(*) AS "TOTALROWS" FROM customer WHERE c_acctbal > 0')
curated("cur_rowcount_fact", "rowcount", request("sales", KEYS, curators={"rowcount": {"config": {"isFactDriven": True}}}, rowsPerPage=5), f'SELECT count(*) AS "TOTALROWS" FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE {L})')
curated(
    "cur_drilldown", "drilldown",
    request("sales", {"Supplier ID": "Supplier ID", "Quantity": "Quantity"}, sort=[("Quantity", "DESC"), ("Supplier ID", "ASC")], rowsPerPage=5, curators={"drilldown": {"config": {"dimension": "Flag", "facts": ["Lines"]}}}),
    f'SELECT l_returnflag AS "Flag", l_suppkey AS "Supplier ID", CAST(sum(l_quantity) AS BIGINT) AS "Quantity", count(*) AS "Lines" FROM lineitem WHERE {L} AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE {L} GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 5) GROUP BY 1, 2',
)


def said(name: str, text: str, sql: str) -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        return trade_engine(spark, sf_dir).sql(text)


DAYS = "\"Day\" BETWEEN '1995-01-01' AND '2001-12-31'"
said("sql_select", f'SELECT "Brand" AS brand, "Quantity" AS quantity, "Unit Price" AS unit_price FROM sales WHERE {DAYS} AND "Type" <> \'PROMO\' ORDER BY quantity DESC, brand OFFSET 2 ROWS FETCH NEXT 8 ROWS ONLY', f"SELECT p_brand AS brand, {Q}, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {L} AND p_type <> 'PROMO' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8 OFFSET 2")
said("sql_where", f"SELECT \"Flag\" AS flag, \"Lines\" AS lines FROM sales WHERE {DAYS} AND (\"Line\" IN ('1', '2') OR \"Line\" > 5 OR \"Line Status\" LIKE '%F%') AND \"Flag\" NOT IN ('N') AND \"Line Status\" IS NOT NULL", f"SELECT l_returnflag AS flag, count(*) AS lines FROM lineitem WHERE {L} AND (l_linenumber IN (1, 2) OR l_linenumber > 5 OR contains(l_linestatus, 'F')) AND l_returnflag NOT IN ('N') GROUP BY 1")
said("sql_having", f'SELECT "Supplier ID" AS id, "Lines" AS lines FROM sales WHERE {DAYS} HAVING "Lines" > 600', f"SELECT l_suppkey AS id, count(*) AS lines FROM lineitem WHERE {L} GROUP BY 1 HAVING count(*) > 600")
said("sql_day_range", "SELECT \"Day\" AS day, \"Lines\" AS lines FROM sales WHERE \"Day\" >= '1997-01-10' AND \"Day\" <= '1997-02-05'", "SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS lines FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-10' AND l_shipdate < TIMESTAMP '1997-02-06' GROUP BY 1")


@query("sql_where_gap", "SELECT event_type AS kind, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1 HAVING count(*) > 300")
def _(spark, sf_dir):
    """Without WHERE, HAVING still counts, and the last seven days are meant."""
    return trade_engine(spark, sf_dir, today=lambda: date(2024, 1, 30)).sql('SELECT "Kind" AS kind, "Events" AS events FROM activity HAVING "Events" > 300')


@query("sql_describe")
def _(spark, sf_dir):
    return trade_engine(spark, sf_dir).sql("DESCRIBE sales")


HOURS = [where("Hour", "Between", "20", "23")]
ask("tz_shift_day", request("activity", {"kind": "Kind", "events": "Events"}, *HOURS, day=where("Day", "Between", "2024-01-10", "2024-01-12"), additionalParameters={"TimeZone": "America/Los_Angeles"}), "SELECT event_type AS kind, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-11 04:00:00' AND ts < TIMESTAMP '2024-01-13 08:00:00' GROUP BY 1")
ask("tz_datetime_between", request("activity", {"kind": "Kind", "events": "Events"}, day=where("Day", "DateTimeBetween", "2024-01-10 22:00:00", "2024-01-12 01:30:00"), additionalParameters={"TimeZone": "Asia/Kolkata"}), "SELECT event_type AS kind, count(*) AS events FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 16:30:00' AND TIMESTAMP '2024-01-11 20:00:00' GROUP BY 1")


@query("tz_widened", "SELECT DATE '2024-01-09' AS lo, DATE '2024-01-13' AS hi")
def _(spark, sf_dir):
    from ..timezone import widened

    lo, hi = widened(date(2024, 1, 10), date(2024, 1, 12))
    return spark.range(1).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


@query("st_latest_wins", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, sf_dir):
    from ..streaming import latest

    return latest(folder(spark, sf_dir)("events"), "user_id", "ts", tie="event_id").select("user_id", "event_id", "event_type", "value")


@query("st_late_ignored", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, sf_dir):
    """A table of the later half, then changes of the earlier half: older versions change nothing."""
    from ..streaming import latest, merged

    e = folder(spark, sf_dir)("events")
    later = latest(e.where("event_id % 2 = 1"), "user_id", "ts", tie="event_id")
    return merged(later, e.where("event_id % 2 = 0"), "user_id", "ts", tie="event_id").select("user_id", "event_id", "event_type", "value")


@query("st_missed_lookups", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def _(spark, sf_dir):
    from ..streaming import missed

    t = folder(spark, sf_dir)
    return missed(t("lineitem"), t("part").where("p_size <= 40"), "l_partkey", "p_partkey")


@query("st_incremental", "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def _(spark, sf_dir):
    from ..streaming import incremental

    d = lambda v: F.lit(v).cast("timestamp_ntz")
    return incremental(folder(spark, sf_dir)("events"), "ts", d("2024-01-10"), d("2024-01-12")).select("event_id", "user_id")


# The choice of tables ---------------------------------------------------------------------------------------------


def _with_facts(*facts):
    r = registry()
    r.cubes["sales", 0] = replace(r.cubes["sales", 0], facts=facts)
    return r


@query("cube_new_rollup", f"SELECT l_partkey AS part_id, {Q}, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE {L} GROUP BY 1")
def _(spark, sf_dir):
    """A rollup by part and day is made, chosen as the cheaper table, and gives the base table's answer."""
    base = sales_fact()
    gone = [c.name for c in base.dims if c.name not in ("l_partkey", "day", "month", "week", "year", "source")]
    small = base.new_rollup("by_part", gone, available_from=date(1990, 1, 1))
    keep = tuple(m for m in small.metrics if m.name in ("quantity", "price"))
    small = replace(small, metrics=keep, default_rows=10)
    day = F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("l_shipdate")
    made = folder(spark, sf_dir)("lineitem").groupBy("l_partkey", day).agg(F.sum("l_quantity").alias("l_quantity"), F.sum("l_extendedprice").alias("l_extendedprice"))
    engine = trade_engine(spark, sf_dir, registry=_with_facts(base, small))
    read = engine.planner.source
    engine.planner.source = lambda name: made if name == "by_part" else read(name)
    body = request("sales", {"part_id": "Part ID", "quantity": "Quantity", "price": "Price"})
    if engine.resolve(body).fact.name != "by_part":
        raise AssertionError("the rollup wasn't chosen")
    return engine.frame(body)


def _choice(name: str, make, expected: list[tuple[str, str]]) -> None:
    """Which table answers which request."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in expected)

    @query(name, f"SELECT * FROM (VALUES {values}) t(request, answer)")
    def _(spark, sf_dir):
        return spark.createDataFrame(make(spark, sf_dir), "request string, answer string")


def _named(spark, sf_dir, facts, bodies: dict[str, dict], **more) -> list[tuple[str, str]]:
    out = []
    for label, body in bodies.items():
        try:
            out.append((label, trade_engine(spark, sf_dir, registry=_with_facts(*facts), **more).resolve(body).fact.name))
        except ValueError:
            out.append((label, "none"))
    return out


PLAIN = request("sales", {"part_id": "Part ID", "quantity": "Quantity"}, day=where("Day", "Between", "1996-01-01", "1998-12-31"))
FINE = request("sales", {"supplier_id": "Supplier ID", "quantity": "Quantity"})
OLD = request("sales", {"part_id": "Part ID", "quantity": "Quantity"}, day=where("Day", "=", "1995-06-01"))


def _small():
    base = sales_fact()
    gone = [c.name for c in base.dims if c.name not in ("l_partkey", "day")]
    return base, base.new_rollup("by_part", gone, available_from=date(1996, 1, 1), default_rows=10)


_choice("cube_best", lambda s, d: _named(s, d, _small(), {"coarse": PLAIN, "fine": FINE, "old": OLD}), [("coarse", "by_part"), ("fine", "lineitem"), ("old", "lineitem")])
_choice("cube_candidates", lambda s, d: _named(s, d, (_small()[1],), {"coarse": PLAIN, "fine": FINE, "old": OLD}), [("coarse", "by_part"), ("fine", "none"), ("old", "none")])
_choice("cube_subset", lambda s, d: _named(s, d, (sales_fact().subset("narrow", ["l_suppkey", "tax"]),), {"coarse": PLAIN, "fine": FINE}), [("coarse", "narrow"), ("fine", "none")])
_choice("cube_available_from", lambda s, d: _named(s, d, (sales_fact().available_onwards("recent", date(1996, 1, 1)),), {"coarse": PLAIN, "old": OLD}), [("coarse", "recent"), ("old", "none")])
_choice("cube_new_schema", lambda s, d: _named(s, d, (sales_fact().new_schema("private", ["internal"]),), {"coarse": PLAIN}), [("coarse", "none")])
_choice("cube_new_grain", lambda s, d: _named(s, d, (sales_fact().new_grain("hours", "hourly"),), {"hourly": {**PLAIN, "filterExpressions": [where("Day", "=", "1996-05-05"), where("Hour", "=", "05")]}}), [("hourly", "hours")])
_choice("cube_new_schema_and_grain", lambda s, d: _named(s, d, (sales_fact().new_schema_and_grain("both", ["default"], "hourly"),), {"coarse": PLAIN}), [("coarse", "both")])


def _engines(s, d):
    from ..plans.select import Preference, RangeLookup

    base = sales_fact()
    other = base.alternative_engine("lineitem_fast", "fast", default_rows=5000)
    prefer = Preference({"fast": RangeLookup([(0, 10**12, 1)]), "spark": RangeLookup([(0, 10**12, 2)])})
    asked = {**PLAIN, "additionalParameters": {"QueryEngine": "spark"}}
    return _named(s, d, (base, other), {"by cost": PLAIN}) + _named(s, d, (base, other), {"by preference": PLAIN, "as asked": asked}, preference=prefer)


_choice("cube_alt_engine", _engines, [("by cost", "lineitem"), ("by preference", "lineitem_fast"), ("as asked", "lineitem")])


def _costs(s, d):
    from ..plans.select import RangeLookup, cost, estimated_rows

    f = replace(sales_fact(), default_rows=100, cost_multiplier=RangeLookup([(0, 1000, 1), (1000, 10000, 3)]))
    rows = [estimated_rows(f, n) for n in (3, 30, 300)]
    return [(str(r), str(min(cost(f, r), 10**15))) for r in rows]


_choice("cube_cost", _costs, [("400", "400"), ("3100", "9300"), ("30100", "1000000000000000")])


def _fk_index(s, d):
    from ..plans.select import KeyIndex

    base, small = _small()
    i = KeyIndex([base, small])
    return [("part", ",".join(f.name for f in i.exact(["part"]))), ("all", ",".join(f.name for f in i.exact(["part", "orders", "supplier"]))), ("holding part", ",".join(f.name for f in i.holding(["part"])))]


_choice("cube_fk_index", _fk_index, [("part", "by_part"), ("all", "lineitem"), ("holding part", "lineitem,by_part")])


def _public(s, d):
    r = registry()
    copy = r.cubes["sales", 0].copy("sales_copy", max_window={})
    r.add(copy)
    body = {**PLAIN, "cube": "sales_copy"}
    return [("copy", trade_engine(s, d, registry=r).resolve(body).cube.name)]


_choice("cube_public", _public, [("copy", "sales_copy")])


def _buckets(s, d):
    from ..plans.select import Buckets

    b = Buckets(((0, 50), (1, 50)), users={"anna": 1}, dry_run=((2, 100),))
    chosen = [b.choose(f"user{i}")[0] for i in range(1000)]
    return [("set by name", str(b.choose("anna")[0])), ("dry run", str(b.choose("x")[1])), ("about half", str(400 < sum(chosen) < 600))]


_choice("cube_bucketing", _buckets, [("set by name", "1"), ("dry run", "2"), ("about half", "True")])
ask("cube_view_rollup", request("branches", {"channel": "Channel", "quantity": "Quantity"}), f"SELECT CASE WHEN l_returnflag = 'R' THEN 'returns' ELSE 'sales' END AS channel, {Q} FROM lineitem WHERE {L} GROUP BY 1")


@query("cur_inject", 'SELECT count(*) AS "TOTALROWS" FROM customer')
def _(spark, sf_dir):
    """A row count that the default result brings along."""
    body = request("sales", {"customer_id": "Customer ID", "segment": "Segment"}, includeRowCount=True, curators={"default": {}})
    return trade_engine(spark, sf_dir).execute({**body, "rowsPerPage": 5})["rowcount"]


def _two_engines(part_type: str):
    """A fast engine that holds returned lines only here, so that the rows tell which was chosen; not for filters that name many keys."""

    def run(spark, sf_dir):
        from ..operators.filters import Filter
        from ..plans.select import Preference, RangeLookup

        r = registry()
        base = sales_fact()
        fast = base.alternative_engine("lineitem_fast", "fast", table="lines_returned")
        r.cubes["sales", 0] = replace(r.cubes["sales", 0], facts=(base, fast))
        r.dims["part"] = replace(r.dims["part"], table=replace(r.dims["part"].table, high_cardinality_filters=(Filter("=", "p_type", ("PROMO",)),)))
        every = lambda n: RangeLookup([(0, 10**12, n)])
        prefer = Preference({"fast": every(1), "spark": every(2)}, {"fast": every(2), "spark": every(1)})
        return trade_engine(spark, sf_dir, registry=r, preference=prefer).frame(request("sales", {"brand": "Brand", "lines": "Lines"}, where("Type", "=", part_type)))

    return run


BRANDS = f"SELECT p_brand AS brand, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {L} AND p_type = "
register("flt_high_card", _two_engines("PROMO"), f"{BRANDS} 'PROMO' GROUP BY 1")
register("flt_low_card", _two_engines("SMALL"), f"{BRANDS} 'SMALL' AND l_returnflag = 'R' GROUP BY 1")


def _of_revision(user: str):
    """Of revision 0 and 1 of the cube, the second reads returned lines only."""

    def run(spark, sf_dir):
        from ..plans.select import Buckets

        r = registry()
        cube = r.cubes["sales", 0]
        r.add(replace(cube, revision=1, facts=tuple(replace(f, table="lines_returned") for f in cube.facts)))
        chosen = Buckets(((0, 0), (1, 100)), users={"anna": 0})
        body = request("sales", {"flag": "Flag", "lines": "Lines"}, additionalParameters={"UserId": user})
        return trade_engine(spark, sf_dir, registry=r, buckets={"sales": chosen}).frame(body)

    return run


COUNTED = f"SELECT l_returnflag AS flag, count(*) AS lines FROM lineitem WHERE {L}"
register("cube_bucketing_user", _of_revision("anna"), f"{COUNTED} GROUP BY 1")
register("cube_bucketing_share", _of_revision("bert"), f"{COUNTED} AND l_returnflag = 'R' GROUP BY 1")


@query("log_requests", "SELECT * FROM (VALUES ('a', 'sales', 'lineitem', 'fact', 'Flag IN', CAST(3 AS BIGINT)), ('b', 'sales', NULL, 'customer', '', 2)) t(request_id, cube, \"table\", driven_by, filters, fields)")
def _(spark, sf_dir):
    """What the engine tells of its requests."""
    from ..requestlog import RequestLog

    log = RequestLog(spark)
    e = trade_engine(spark, sf_dir, listeners=(log,))
    e.frame(request("sales", {"flag": "Flag", "brand": "Brand", "lines": "Lines"}, where("Flag", "In", "R"), additionalParameters={"RequestId": "a"}))
    e.frame(request("sales", {"customer_id": "Customer ID", "segment": "Segment"}, additionalParameters={"RequestId": "b"}))
    return log.frame().select("request_id", "cube", "table", "driven_by", F.upper(F.array_join("filters", ",")).alias("f"), F.size("fields").cast("bigint").alias("fields")).withColumn("filters", F.regexp_replace("f", "FLAG", "Flag")).drop("f")


@query("lkp_store", "SELECT c_nationkey AS id, max_by(c_name, c_custkey) AS name, max(c_custkey) AS newest FROM customer GROUP BY 1")
def _(spark, sf_dir):
    """A store that is loaded, pulls what is newer, and is looked up in: of each key the newest row."""
    from ..sources import scratch
    from ..streaming import LookupStore

    rows = folder(spark, sf_dir)("customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("newest"))
    store = LookupStore(spark, scratch(spark), "id", "newest")
    store.refresh(rows.where("newest % 3 = 0"))
    store.apply(rows.where("newest % 3 = 1"), 0)
    store.apply(rows.where("newest % 3 = 2"), 1)
    store.pull(rows)
    return store.namespace("customers").df
