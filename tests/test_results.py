"""Small fixtures with answers worked out by hand."""

from __future__ import annotations

import json
from datetime import date

import duckdb
import pytest

from prismcube import catalog
from prismcube.engine import Engine
from prismcube.model import Cube, DateType, DecType, DimCol, DimTable, FactCol, FactTable, IntType, PublicCol, PublicDim, Registry, StrType
from prismcube.operators.filters import F_in
from prismcube.operators.joins import salted
from prismcube.operators.rollups import NOOP, Theta, ThetaSetOp
from prismcube.sources import places
from prismcube.streaming import LookupStore, latest


@pytest.fixture(scope="module")
def school(spark):
    """Marks of a student in two sections, at the day and eleven days before."""
    marks = spark.createDataFrame(
        [(1, 100, 213, 200, 125, "2024-03-12"), (2, 100, 213, 198, 120, "2024-03-11"), (1, 100, 213, 200, 110, "2024-03-01"), (2, 100, 213, 198, 98, "2024-02-29"), (3, 0, 999, 7, 5, "2024-03-12"), (4, None, 213, 300, 40, "2024-03-12")],
        "class_id long, total long, student_id long, section_id long, obtained long, day string",
    ).selectExpr("class_id", "total", "student_id", "section_id", "obtained", "cast(day as date) as day")
    students = spark.createDataFrame([(213, "One", "Full"), (214, "Two 50%_off\\", None)], "id long, name string, status string")
    fact = FactTable(
        "marks", (DimCol("student_id", IntType(), foreign_key="student"), DimCol("section_id", IntType()), DimCol("day", DateType())),
        (FactCol("obtained", IntType()), FactCol("total", IntType()), FactCol("factor", DecType(scale=4), NOOP, expr="{obtained} /- {total}", uses=("obtained", "total"))), day_column="day",
    )
    student = DimTable("student", (DimCol("id", IntType(), primary_key=True), DimCol("name", case_insensitive=True), DimCol("status", StrType())), table="students")
    own = lambda *n: tuple(PublicCol(a, c) for a, c in n)
    cube = Cube("marks", (fact,), own(("Student ID", "student_id"), ("Section", "section_id"), ("Day", "day")), own(("Obtained", "obtained"), ("Total", "total"), ("Factor", "factor")))
    reg = Registry().add(cube, PublicDim("student", student, own(("Student ID", "id"), ("Name", "name"), ("Status", "status"))))
    return Engine(spark, reg, places(spark, {"marks": marks, "students": students}), today=lambda: date(2024, 3, 12))


def body(fields, *filters, lo="2024-03-11", hi="2024-03-12", **more):
    return {"cube": "marks", "selectFields": [{"field": f} for f in fields], "filterExpressions": [{"field": "Day", "operator": "Between", "from": lo, "to": hi}, *filters], **more}


def test_time_shift(school):
    out = school.execute(body(["Student ID", "Section", "Obtained"], curators={"timeshift": {"config": {"daysOffset": 9}}}, lo="2024-03-11", hi="2024-03-12"))["timeshift"]
    rows = {r["Section"]: (r["Obtained"], r["Obtained Prev"], r["Obtained Pct Change"]) for r in out.collect()}
    # The window before ends ten days earlier: 2024-02-29 to 2024-03-01.
    assert rows == {200: (125, 110, 13.64), 198: (120, 98, 22.45), 7: (5, 0, 100.0), 300: (40, 0, 100.0)}
    assert out.columns == ["Student ID", "Section", "Obtained", "Obtained Prev", "Obtained Pct Change"]
    assert [r["Section"] for r in out.collect()][2] == 198


def test_safe_division(school):
    rows = {r["Section"]: r["Factor"] for r in school.frame(body(["Section", "Factor"])).collect()}
    assert rows == {200: 1.25, 198: 1.2, 7: 0.0, 300: None}


def test_unknown_key_is_kept_and_a_dimension_without_facts_comes_with_dimension_driven_requests(school):
    fact = {(r["Student ID"], r["Name"]) for r in school.frame(body(["Student ID", "Name", "Obtained"])).collect()}
    assert fact == {(213, "One"), (999, None)}
    dim = {(r["Name"], r["Obtained"]) for r in school.frame(body(["Name", "Obtained"], forceDimensionDriven=True)).collect()}
    assert dim == {("One", 285), ("Two 50%_off\\", None)}


@pytest.mark.parametrize(("value", "n"), [("50%", 1), ("%_OFF", 1), ("f\\", 1), ("%", 1), ("5_%", 0)])
def test_like_is_literal(school, value, n):
    assert school.frame(body(["Name"], {"field": "Name", "operator": "Like", "value": value})).count() == n


def test_nulls_come_last_either_way(school):
    for order in ("ASC", "DESC"):
        rows = school.frame(body(["Section", "Factor"], sortBy=[{"field": "Factor", "order": order}])).collect()
        assert rows[-1]["Factor"] is None


def test_pages_with_ties(school):
    pages = [school.frame(body(["Section", "Student ID"], sortBy=[{"field": "Student ID"}, {"field": "Section"}], paginationStartIndex=k, rowsPerPage=1)).collect()[0]["Section"] for k in range(4)]
    assert pages == [198, 200, 300, 7]


def test_page_before_the_join_has_the_same_rows(school):
    asked = body(["Student ID", "Name", "Obtained"], sortBy=[{"field": "Obtained", "order": "DESC"}], rowsPerPage=1)
    assert [tuple(r) for r in school.frame(asked).collect()] == [(213, "One", 285)]


def test_drill_down_and_totals(school):
    asked = body(["Student ID", "Obtained"], sortBy=[{"field": "Obtained", "order": "DESC"}], rowsPerPage=1, curators={"drilldown": {"config": {"dimension": "Section"}}, "totalmetrics": {}})
    out = school.execute(asked)
    assert {(r["Section"], r["Obtained"]) for r in out["drilldown"].collect()} == {(200, 125), (198, 120), (300, 40)}
    assert out["totalmetrics"].collect()[0]["Obtained"] == 290


def test_envelope(school):
    from prismcube.output import csv_lines, envelope

    r = school.resolve(body(["Section", "Obtained"], includeRowCount=True, sortBy=[{"field": "Section"}]))
    out = json.loads("".join(envelope(r, school.planner.frame(r))))
    assert out["header"]["fields"] == [{"fieldName": "Section", "fieldType": "DIM"}, {"fieldName": "Obtained", "fieldType": "FACT"}, {"fieldName": "TOTALROWS", "fieldType": "CONSTANT"}]
    assert out["rows"][0] == [7, 5, 4]
    assert list(csv_lines(school.frame(body(["Name"]))))[0] == "Name"


def test_empty_tables(spark, school):
    nothing = Engine(spark, school.registry, lambda n: school.planner.source(n).limit(0), today=school.today)
    assert nothing.frame(body(["Name", "Section", "Factor"])).count() == 0
    assert nothing.frame(body(["Obtained"])).collect()[0]["Obtained"] is None


def test_salted_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k int, w string")
    assert salted(left, right, "k", 4, "left").count() == 51
    assert salted(left, right, "k", 4).count() == 50


def test_latest_wins_in_a_stream(spark, tmp_path):
    batches = [[(1, "a", 10), (2, "b", 10)], [(1, "late", 5), (2, "c", 20), (3, "d", 1)]]
    store = LookupStore(spark, str(tmp_path / "store"), "k", "ts", tie="v")
    inbox = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k int, v string, ts long").coalesce(1).write.mode("append").json(str(inbox))
        q = store.follow(spark.readStream.schema("k int, v string, ts long").json(str(inbox)), str(tmp_path / "cp"), once=True)
        q.awaitTermination()
        assert store.versions()[-1] == (0, n + 1)
    assert {tuple(r) for r in store.read().collect()} == {(1, "a", 10), (2, "c", 20), (3, "d", 1)}
    store.refresh(spark.createDataFrame([(9, "z", 30)], "k int, v string, ts long"))
    assert store.read().count() == 4


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "k int, v string, ts long")
    assert latest(df, "k", "ts", tie="v").collect()[0]["v"] == "b"


@pytest.fixture(scope="module")
def visits(spark):
    """40,000 users of four countries; the first 30,000 come by web, those from 10,000 by app, those from 12,000 by post."""
    rows = spark.range(40000).selectExpr("id as u", "id % 4 as country", "explode(filter(array(if(id < 30000, 'web', ''), if(id >= 10000, 'app', ''), if(id >= 12000, 'post', '')), x -> x <> '')) as way", "date'2024-03-12' as day")
    of = lambda c, *ways: Theta(c, where=(F_in("way", *ways),) if ways else ())
    web, app, post = (of("u", w) for w in ("web", "app", "post"))
    sets = {
        "users": of("u"), "by_web": web, "both": ThetaSetOp("INTERSECT", (web, app)), "three": ThetaSetOp("INTERSECT", (web, app, post)),
        "either": ThetaSetOp("UNION", (web, app)), "only_web": ThetaSetOp("NOT", (web, app)), "only_app": ThetaSetOp("NOT", (app, web, post)),
    }
    dims = (DimCol("country", IntType(), foreign_key="country"), DimCol("way"), DimCol("day", DateType()))
    fact = FactTable("visits", dims, tuple(FactCol(k, IntType(), v) for k, v in sets.items()), day_column="day")
    places_of = DimTable("country", (DimCol("id", IntType(), primary_key=True), DimCol("name"), DimCol("part")), table="countries")
    own = lambda names: tuple(PublicCol(n, n) for n in names)
    reg = Registry().add(Cube("visits", (fact,), (*own(("way",)), PublicCol("Day", "day")), own(sets)), PublicDim("country", places_of, (PublicCol("Country", "id"), *own(("name", "part")))))
    countries = spark.createDataFrame([(0, "a", "n"), (1, "b", "n"), (2, "c", "s"), (3, "d", "s")], "id long, name string, part string")
    return Engine(spark, reg, places(spark, {"visits": rows, "countries": countries}), today=lambda: date(2024, 3, 12)), list(sets)


def theta_rows(visits, names, *fields, **more):
    return sorted(tuple(r) for r in visits[0].frame({**body([*fields, *names]), "cube": "visits", **more}).collect())


def test_theta_set_operations_are_exact_beyond_a_sketch(visits):
    assert theta_rows(visits, ["both", "three", "either", "only_web", "only_app"]) == [(20000, 18000, 40000, 10000, 0)]


def test_theta_counts_exactly_beyond_a_sketch(visits):
    assert theta_rows(visits, ["users", "by_web"]) == [(40000, 30000)]
    assert theta_rows(visits, ["users"], "way") == [("app", 30000), ("post", 28000), ("web", 30000)]


def test_theta_above_joins(visits):
    """By a column of the dimension: grouped below the join, and again above it; also where the dimension drives."""
    want = [(p, 20000, 10000, 9000) for p in "ns"]
    assert theta_rows(visits, ["users", "both", "three"], "part") == want
    assert theta_rows(visits, ["users", "both", "three"], "part", forceDimensionDriven=True) == want


@pytest.mark.parametrize("name", ["agg_theta_setop", "set_theta"])
def test_theta_queries_over_more_users_than_a_sketch_has(spark, tmp_path, name):
    kinds = "element_at(array('purchase', 'click', 'error'), cast(id % 3 as int) + 1)"
    spark.range(120000).selectExpr("id as event_id", "timestamp'2024-01-05 10:00:00' as ts", "id div 4 as user_id", f"{kinds} as event_type", "1.0D as value", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    sql = catalog.oracle_sql()[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duckdb.sql(sql)
    assert [tuple(r[c] for c in want.columns) for r in catalog.queries()[name](spark, str(tmp_path)).collect()] == want.fetchall()
