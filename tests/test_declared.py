"""What a cube can declare: expressions, what a request fills into them, lookups, functions on the result; and a database as a source."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prismcube.cubes.trade import trade_engine
from prismcube.curators import CURATORS
from prismcube.functions import derived
from prismcube.functions.derived import ExpressionError, parse, with_replacements
from prismcube.functions.lookup import Namespace
from prismcube.model import Lookup, ModelError
from prismcube.output import csv_lines
from prismcube.plans.select import Buckets
from prismcube.request import RequestError
from prismcube.sources import jdbc

DAYS = {"field": "Day", "operator": "Between", "from": "1995-01-01", "to": "2001-12-31"}


def body(*fields, **more):
    return {"cube": "sales", "selectFields": [f if isinstance(f, dict) else {"field": f} for f in fields], "filterExpressions": [DAYS], **more}


def value(spark, text: str, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return df.select(parse(text, F.col).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("start_of_the_week({w})", "2024-02-12"), ("start_of_the_week('2020-53')", "2020-12-28"), ("start_of_the_week('2021-1')", "2021-01-04"), ("start_of_the_week('nothing')", None), ("start_of_the_week({n})", None),
        ("decode({n}, 'a', 1)", None), ("decode_retain({w}, 'x', 'y')", "2024-7"), ("trunc(-2.7)", -2), ("trunc(2.7)", 2), ("substr('abcdef', 2, 3)", "cde"), ("number(2.5, 0)", 2.0), ("number({n}, 0)", None),
        ("compare_percentage(1, 4, 50, 'low', 'high')", "low"), ("compare_percentage(2, 4, 50, 'low', 'high')", "high"), ("regex_extract('ab12', '(\\d+)', 1)", "12"), ("regex_extract('ab', '(\\d+)', 1, 'it''s none')", "it's none"),
        ("format_date({n}, 'yyyy')", "NULL"), ("day_of_week('20240212', 'yyyyMMdd')", "Monday"), ("concat('a', '<b>')", "a<b>"), ("1 /- 0", 0.0),
    ],
)
def test_functions(spark, text, want):
    assert value(spark, text, w="2024-7", n=None) == want if "{" in text else value(spark, text) == want


@pytest.mark.parametrize("text", ["decode({a})", "substr({a})", "javascript('never registered', {a})", "get_interval_date({a}, 'century')", "unknown({a})", "time_format_period({a}, 'y', 'P9Y')"])
def test_wrong_functions(text):
    with pytest.raises(ExpressionError):
        parse(text, lambda n: F.lit(n))


def test_what_a_request_says_stays_a_constant():
    assert with_replacements("{a} * <n> + <m|2>", {"n": 3}) == "{a} * 3 + 2"
    assert with_replacements("concat({a}, '<who>')", {"who": "x'), sum({b}"}) == "concat({a}, 'x''), sum({b}')"
    for bad in ("sum({b})", "1, 2", "'x'"):
        with pytest.raises(ExpressionError):
            with_replacements("{a} * <n>", {"n": bad})
    with pytest.raises(ExpressionError):
        with_replacements("{a} * <n>", {})


def test_native_functions(spark):
    derived.register_native("plus one", lambda c: c + 1)
    assert value(spark, "javascript('plus one', 41)") == 42


def test_wrong_lookups(spark, data):
    with pytest.raises(ModelError):
        Lookup("n", "k")
    with pytest.raises(ModelError):
        Lookup("n", "k", "v", keys=((1, "a"),), values=(("b", "c"),))
    look = {"field": "Part ID", "alias": "v", "lookup": {"namespace": "part", "column": "p_brand"}}
    with pytest.raises(RequestError):
        trade_engine(spark, data).frame(body(look, "Lines"))
    with pytest.raises(RequestError):
        trade_engine(spark, data).frame(body({**look, "lookup": {"namespace": "part"}}))
    with pytest.raises(RequestError):
        trade_engine(spark, data).frame(body({**look, "field": "Nation"}))


def test_newest_row_of_a_key_is_looked_up(spark, data):
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "", 1), (None, "never", 1)], "id long, v string, at long")
    look = {"field": "Part ID", "alias": "v", "lookup": {"namespace": "n", "column": "v", "missing": "none"}}
    out = trade_engine(spark, data, namespaces={"n": Namespace("n", rows, "id", updated="at")}).frame(body({"field": "Part ID", "alias": "id"}, look, "Lines", rowsPerPage=-1))
    got = {r.id: r.v for r in out.collect()}
    assert got[1] == "new" and got[2] == "none" and got[3] == "none"


def test_a_lookup_filter_groups_before_it_joins(spark, data):
    part = spark.read.parquet(f"{data}/part.parquet")
    look = {"field": "Part ID", "alias": "v", "lookup": {"namespace": "part", "column": "p_brand"}}
    engine = trade_engine(spark, data, namespaces={"part": Namespace("part", part, "p_partkey")})
    plan = engine.frame(body(look, "Lines", rowsPerPage=-1))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: [len(x) - len(x.lstrip(" :+-")) for x in plan if x.lstrip(" :+-").startswith(word)]
    assert len(depth("Aggregate")) == 2 and max(depth("Aggregate")) > depth("Join")[0] > min(depth("Aggregate"))


def test_engines_revisions_and_patterns(spark, data):
    e = trade_engine(spark, data)
    with pytest.raises(RequestError, match="fast"):
        e.frame(body("Flag", "Lines", additionalParameters={"QueryEngine": "fast"}))
    assert Buckets(((0, 0), (1, 100)), users={"anna": 0}).choose("anna")[0] == 0
    for pattern in ("abc%", "%a_c%", "%a%c%", "abc", "%"):
        with pytest.raises(RequestError):
            e.sql(f"SELECT \"Lines\" FROM sales WHERE \"Flag\" LIKE '{pattern}'")
    with pytest.raises(RequestError):
        e.frame(body("Flag", "Lines", additionalParameters={"RowNumber": True}, rowsPerPage=-1))


def test_row_count_comes_with_a_page(spark, data):
    e = trade_engine(spark, data)
    page = body("Supplier ID", "Lines", includeRowCount=True, rowsPerPage=3)
    assert set(e.execute(page)) == {"default", "rowcount"} and set(e.execute({**page, "includeRowCount": False})) == {"default"}
    exact = e.execute({**page, "curators": {"rowcount": {"config": {"isFactDriven": True}}, "default": {}}})["rowcount"].first()[0]
    assert exact == spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey").distinct().count()
    driven = {"cube": "sales", "selectFields": [{"field": "Customer ID"}], "filterExpressions": [DAYS], "forceDimensionDriven": True, "includeRowCount": True}
    assert set(e.execute(driven)) == {"default"} and "default" in CURATORS


def test_only_pages_go_through_the_driver(spark, data):
    e = trade_engine(spark, data)
    assert len(list(csv_lines(e.frame(body("Supplier ID", "Lines", rowsPerPage=3))))) == 4
    with pytest.raises(ValueError, match="page"):
        list(csv_lines(e.frame(body("Supplier ID", "Lines", rowsPerPage=-1))))


def test_database(spark, data, tmp_path):
    """A table of a database, read in parts, behind a cube."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.read.parquet(f"{data}/part.parquet").write.format("jdbc").options(dbtable="part", **options).save()
    there = jdbc(url, "part", column='"p_partkey"', lower=1, upper=200, parts=3, driver=options["driver"])
    df = there.read(spark)
    assert df.rdd.getNumPartitions() == 3 and df.count() == spark.read.parquet(f"{data}/part.parquet").count()
    e = trade_engine(spark, data)
    want = sorted(map(tuple, e.frame(body("Brand", "Quantity", rowsPerPage=-1)).collect()))
    own = e.planner.source
    e.planner.source = lambda name: df if name == "part" else own(name)
    assert sorted(map(tuple, e.frame(body("Brand", "Quantity", rowsPerPage=-1)).collect())) == want


def test_stores_load_pull_and_follow(spark, tmp_path):
    from prismcube.sources import Location
    from prismcube.streaming import LookupStore, publish

    (tmp_path / "full.tsv").write_text("1\tone\t10\n2\ttwo\t10\n")
    full = Location("tsv", str(tmp_path / "full.tsv"), "id long, name string, at long").read(spark)
    store = LookupStore(spark, str(tmp_path / "store"), "id", "at", "name")
    assert store.read() is None
    store.refresh(full)
    held = lambda: {r.id: r.name for r in store.read().collect()}
    assert held() == {1: "one", 2: "two"}
    newer = spark.createDataFrame([(1, "uno", 12), (3, "three", 11), (2, "late", 9), (3, "tie", 11)], "id long, name string, at long")
    assert store.pull(newer) == 3 and held() == {1: "uno", 2: "two", 3: "tie"}
    assert store.pull(newer) == 1 and held() == {1: "uno", 2: "two", 3: "tie"}  # those of the newest time come again
    newer.write.parquet(str(tmp_path / "stream"))
    store.refresh(full, replace=True)  # a snapshot, and the stream on top of it
    assert held() == {1: "one", 2: "two"}
    stream = spark.readStream.schema(newer.schema).parquet(str(tmp_path / "stream"))
    store.follow(stream, str(tmp_path / "at"), once=True).awaitTermination()
    assert held() == {1: "uno", 2: "two", 3: "tie"}
    store.forget(1)
    assert len(store.versions()) == 1 and held() == {1: "uno", 2: "two", 3: "tie"}
    publish(store.read().where("id = 3"), "id", format="json", path=str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().key == "3"


def test_request_log_and_transformers(spark, data, tmp_path):
    from prismcube.requestlog import RequestLog

    log = RequestLog(spark, path=str(tmp_path / "log"), size=2)
    e = trade_engine(spark, data, listeners=(log,), transformers=(lambda df, r: df.withColumn("cube", F.lit(r.cube.name)),))
    for k in range(3):
        out = e.frame(body("Flag", "Lines", additionalParameters={"RequestId": str(k)}))
    assert out.columns == ["Flag", "Lines", "cube"] and len(log.records) == 1
    log.flush()
    assert sorted(r.request_id for r in spark.read.json(str(tmp_path / "log")).collect()) == ["0", "1", "2"]
