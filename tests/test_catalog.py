"""Every query of the catalog against SQL on the same tables."""

from __future__ import annotations

import pytest

from prismcube import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
KINDS = {"bigint": {"BIGINT"}, "int": {"INTEGER", "BIGINT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "date": {"DATE"}, "boolean": {"BOOLEAN"}}


def plain(rows) -> list[tuple[str, ...]]:
    return sorted(tuple(repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    types = {d[0]: str(d[1]) for d in found.description}
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert plain(got) == plain(want)
    for c, kind in df.dtypes:
        assert types[c] in KINDS.get(kind, {types[c]}), (c, kind, types[c])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_approximate_counts_are_close(spark, data):
    exact = {r.day: r.users for r in QUERIES["agg_hll_unique_exact"](spark, data).collect()}
    for r in QUERIES["agg_hll_unique"](spark, data).collect():
        assert abs(r.users - exact[r.day]) <= max(1, 0.05 * exact[r.day])
