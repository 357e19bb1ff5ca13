"""Requests: form, checks, join types, choice of tables; without running queries."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from prismcube.catalog import request, where
from prismcube.cubes.trade import TODAY, registry, sales_fact
from prismcube.functions.derived import ExpressionError, references, with_replacements
from prismcube.model import DimCol, DimTable, FactCol, FactTable, ModelError, union_view
from prismcube.operators.filters import F_eq, F_in, Filter, FilterError, parse, rewrite_labels, with_forced
from prismcube.plans.resolve import resolve
from prismcube.plans.select import Buckets, Candidate, RangeLookup, best
from prismcube.request import RequestError, from_json
from prismcube.sqlfront import parse_sql
from prismcube.timezone import hours_to_utc, widened, windows


def resolved(body, **more):
    return resolve(registry(), from_json(body), today=TODAY, **more)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"cube": ""}, "cube missing"), ({"selectFields": []}, "selectFields missing"), ({"filterExpressions": []}, "Day filter"), ({"forceDimensionDriven": True, "forceFactDriven": True}, "driven"),
        ({"queryType": "other"}, "unknown queryType"), ({"paginationStartIndex": -1}, "below 0"), ({"selectFields": [{"field": "Flag"}, {"field": "Line", "alias": "Flag"}]}, "one alias"),
    ],
)
def test_form(change, message):
    with pytest.raises(RequestError, match=message):
        from_json({**request("sales", {"f": "Flag"}), **change})


@pytest.mark.parametrize(
    ("body", "message"),
    [
        (request("nothing", {"f": "Flag"}), "no cube"), (request("sales", {"f": "No Such"}), "no field"), (request("sales", {"f": "Flag"}, sort=[("x", "ASC")]), "isn't selected"),
        (request("sales", {"f": "Flag"}, {"operator": "Or", "filterExpressions": [where("Flag", "=", "R"), where("Quantity", ">", 1)]}), "can't mix"),
        (request("sales", {"f": "Flag"}, {"operator": "Outer", "outerFilters": [where("Flag", "IsNull")]}), "isn't selected"),
        (request("sales", {"f": "Flag"}, day=where("Day", "Between", "1997-01-02", "1997-01-01")), "is after"),
        (request("sales", {"f": "Flag"}, day=where("Day", "=", "yesterday")), "no day"),
    ],
)
def test_refused(body, message):
    with pytest.raises(ValueError, match=message):
        resolved(body)


def test_hour_has_the_operator_of_day():
    with pytest.raises(RequestError, match="another operator"):
        from_json(request("activity", {"k": "Kind"}, where("Hour", "=", "1")))


def test_join_types():
    assert resolved(request("sales", {"o": "Order ID", "p": "Priority", "q": "Quantity"})).join == "left"
    assert resolved(request("sales", {"o": "Order ID", "p": "Priority", "q": "Quantity"}, where("Priority", "=", "x"))).join == "inner"
    assert resolved(request("sales", {"s": "Supplier", "q": "Quantity"}, forceDimensionDriven=True)).join == "right"
    assert resolved(request("sales", {"s": "Supplier", "q": "Quantity"}, where("Quantity", ">", 3), forceDimensionDriven=True)).join == "inner"
    r = resolved(request("sales", {"s": "Supplier ID", "q": "Quantity"}, where("Supplier Balance", ">", 3)))
    assert r.semi == ["supplier"] and not r.steps


def test_path_through_dimensions_in_between():
    r = resolved(request("sales", {"c": "Customer", "r": "Region", "q": "Quantity"}))
    assert [(s.dim, s.via) for s in r.steps] == [("orders", ""), ("customer", "orders"), ("nation", "customer"), ("region", "nation")]


def test_labels():
    t = registry().dims["orders"].table.column("o_orderstatus").type
    assert rewrite_labels(F_eq("s", "Open"), t).values == ("O",)
    with pytest.raises(FilterError, match="no label"):
        rewrite_labels(F_eq("s", "Gone"), t)
    with pytest.raises(FilterError, match="has labels"):
        rewrite_labels(Filter("Like", "s", ("O",)), t)


@pytest.mark.parametrize("body", [{}, {"operator": "In", "field": "a", "values": []}, {"operator": "In", "field": "a", "values": [""]}, {"operator": "Between", "field": "a", "from": 1}, {"operator": "==", "field": "a"}, {"operator": "wat", "field": "a"}, {"operator": "=", "field": "a"}, {"operator": "Or"}, {"operator": "JavaScript", "field": "a", "value": "x"}])
def test_filters_that_cannot_be_read(body):
    with pytest.raises(FilterError):
        parse(body)


def test_force_flags_are_never_taken_from_json():
    f = parse({"operator": "=", "field": "a", "value": "x", "isForceFilter": True, "isOverridable": True})
    assert not f.forced and not f.overridable


def test_forced_filters():
    forced = [F_in("s", "a", overridable=True), F_in("t", "b")]
    assert [f.field for f in with_forced([], forced)] == ["s", "t"]
    assert [f.values for f in with_forced([F_eq("s", "z"), F_eq("t", "y")], forced)] == [("z",), ("y",), ("b",)]
    assert len(with_forced([F_in("t", "b")], [F_in("t", "b")])) == 1


def test_windows():
    r = from_json(request("activity", {"k": "Kind"}, where("Hour", "Between", "22", "03"), day=where("Day", "Between", "2024-01-01", "2024-01-02")))
    (w,) = windows(r)
    assert (w.start, w.end) == (datetime(2024, 1, 1, 22), datetime(2024, 1, 2, 4))
    (w,) = windows(r, "America/New_York")
    assert (w.start, w.end) == (datetime(2024, 1, 2, 3), datetime(2024, 1, 2, 9))
    assert hours_to_utc(date(2024, 1, 1), date(2024, 1, 2), 22, 3, "America/New_York") == (date(2024, 1, 2), date(2024, 1, 2), 3, 8)
    assert widened(date(2024, 1, 1), date(2024, 1, 1)) == (date(2023, 12, 31), date(2024, 1, 2))


def test_range_lookup_and_best():
    r = RangeLookup([(0, 10, "a"), (10, 20, "b")])
    assert [r.find(k) for k in (-1, 0, 9, 10, 19, 20)] == [None, "a", "a", "b", "b", None]
    with pytest.raises(ValueError, match="two ranges"):
        RangeLookup([(0, 10, "a"), (9, 20, "b")])
    f = sales_fact()
    small = f.subset("small", [])
    assert [c.fact.name for c in best([Candidate(f, 5, 5), Candidate(small, 5, 5)])] == ["small", "lineitem"]
    assert [c.fact.name for c in best([Candidate(f, 5, 4), Candidate(small, 5, 5)])] == ["lineitem", "small"]


def test_buckets():
    with pytest.raises(ValueError, match="100"):
        Buckets(((0, 50),))


def test_model_errors():
    with pytest.raises(ModelError, match="one primary key"):
        DimTable("d", (DimCol("a"), DimCol("b")))
    with pytest.raises(ModelError, match="declared twice"):
        FactTable("f", (DimCol("a"),), (FactCol("a"),))
    with pytest.raises(ModelError, match="unknown column"):
        FactTable("f", (DimCol("a", uses=("z",)),), ())
    with pytest.raises(ModelError, match="keeps a foreign key"):
        sales_fact().new_rollup("x", [c.name for c in sales_fact().dims], available_from=date(2000, 1, 1))
    a = FactTable("a", (DimCol("k"),), (FactCol("m"),))
    b = FactTable("b", (DimCol("other"),), (FactCol("m"),))
    with pytest.raises(ModelError, match="other columns"):
        union_view("v", ((a, {}), (b, {})))


def test_expressions():
    assert references("sum({a} * {b}) /- {c}") == ["a", "b", "c"]
    with pytest.raises(ExpressionError, match="no value"):
        with_replacements("{a} * <factor>", {})


def sql(text):
    return parse_sql(text, registry(), today=date(1999, 1, 8))


def test_sql():
    r = sql('SELECT "Flag", "Lines" AS n FROM x.SALES WHERE "Day" = \'1998-01-01\' AND ("Flag" = \'R\' OR "Flag" = \'A\' OR "Line" > 3) ORDER BY n DESC LIMIT 5 OFFSET 2')
    assert r.cube == "sales" and [f.alias for f in r.fields] == ["Flag", "n"] and r.day.values == ("1998-01-01",) and (r.rows, r.start) == (5, 2) and r.sort[0].descending
    assert r.filters[0].op == "Or" and len(r.filters[0].children) == 3
    assert sql('SELECT "Lines" FROM sales').day.values == ("1999-01-01", "1999-01-08")
    assert sql('SELECT * FROM sales').fields[0].field == "Quantity"
    assert sql("DESCRIBE sales") == "sales"


@pytest.mark.parametrize("text", ['SELECT "Lines" FROM sales WHERE "Line" >= 3', 'SELECT "Lines" FROM nowhere', 'SELECT DISTINCT "Flag" FROM sales', 'SELECT "Lines" FROM sales WHERE', 'SELECT "Lines" FROM sales GROUP BY 1', "UPDATE sales"])
def test_sql_that_is_refused(text):
    with pytest.raises((RequestError, IndexError)):
        sql(text)
