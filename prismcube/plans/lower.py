"""Lowers a resolved request to one DataFrame.

The fact is filtered, aggregated to the keys of its dimensions, and then joined, so that joins see groups instead of
rows.  Where the result leaves a key out, the joined groups are aggregated again on what is shown; metrics are carried
as primitives and computed last.  Distinct values are grouped by below the joins and counted above them; other metrics
that can't be aggregated twice are aggregated once, above the joins.  A page
that is sorted by columns of one side only is cut before the join.  No hint asks for a broadcast: Spark does that by
the measured size of a side, and adaptive execution splits skewed joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.derived import parse, references
from ..functions.lookup import Namespace, attach, columns_of
from ..functions.lookup import value as found_value
from ..model import DateType, DimCol, DimTable, FactTable, Registry, TimestampType, bound, mapped
from ..operators.filters import Filter, FilterError, all_of, column_predicate, combined, predicate, with_forced
from ..request import RequestError
from ..timezone import windows, within
from .metrics import Metrics, looked_up, raw_column
from .resolve import Item, Resolved

TOTAL, ROWNUM = "TOTALROWS", "ROWNUM"


def constant_test(f: Filter, value) -> bool:
    """A filter on a branch's constant; only equality can be decided so."""
    if f.op in ("=", "In"):
        return str(value) in {str(v) for v in f.values}
    raise FilterError(f"{f.op} can't be used on {f.field}, a constant of a view")


class Planner:
    """source: name of a table -> DataFrame.  namespaces: name -> Namespace, for columns that are looked up."""

    def __init__(self, spark: SparkSession, registry: Registry, source: Callable[[str], DataFrame], namespaces: Callable[[str], Namespace] | None = None):
        self.spark, self.registry, self.source, self.namespaces = spark, registry, source, namespaces
        self.context: dict = {}  # what the request in hand says

    # Lookups ----------------------------------------------------------------------------------------------------------

    def attached(self, df: DataFrame, cols: list[DimCol], key: Callable[[DimCol], Column]) -> DataFrame:
        """df with what `cols` look up: one left join for each namespace and key, however many columns it gives."""
        by: dict[tuple[str, str], list[DimCol]] = {}
        for c in cols:
            by.setdefault((c.lookup.namespace, c.lookup.key), []).append(c)
        for (name, _), some in by.items():
            if self.namespaces is None:
                raise RequestError(f"there is no namespace {name}")
            needed = sorted({n for c in some for n in columns_of(c.lookup)})
            df = attach(df.withColumn("_at", key(some[0])), self.namespaces(name), "_at", needed)
            df = df.withColumns({looked_up(c.name): found_value(c.lookup, F.col("_at"), lambda n: F.col(f"_{n}")) for c in some}).drop("_at", *[f"_{n}" for n in needed])
        return df

    @staticmethod
    def looking(table, names: Iterable[str]) -> list[DimCol]:
        """The columns among `names`, and among what they are derived of, that are looked up."""
        out: dict[str, DimCol] = {}

        def add(name: str) -> None:
            col = table.column(name)
            if isinstance(col, DimCol) and col.name not in out:
                if col.lookup:
                    out[col.name] = col
                for u in (*col.uses, *(references(col.expr) if isinstance(col.expr, str) else ())):
                    if u != name:
                        add(u)

        for n in names:
            add(n)
        return list(out.values())

    # Facts ----------------------------------------------------------------------------------------------------------

    def table(self, names: str) -> DataFrame:
        """A table, or the union of several that are joined by commas."""
        out = None
        for n in names.split(","):
            df = self.source(n.strip())
            out = df if out is None else out.unionByName(df)
        return out

    def rows(self, r: Resolved, fact: FactTable, needed: Iterable[str]) -> tuple[DataFrame, bool]:
        """Filtered rows of the fact, and whether they have the model's names."""
        if not fact.views:
            df = self.table(fact.table or fact.name)
            return self._where(df, r, fact, [f for f in r.fact_filters if f not in r.looking[1]], False), False
        out = None
        consts = set(fact.views[0][1])
        needed = sorted(set(needed) - consts)
        for branch, values in fact.views:
            own = [f for f in r.fact_filters if f.fields() & consts]
            if not all(constant_test(f, values[f.field]) for f in own):
                continue  # the branch isn't read at all
            df = self._where(self.table(branch.table or branch.name), r, branch, [f for f in r.fact_filters if not f.fields() & consts and f not in r.looking[1]], False)
            df = df.select(*[raw_column(branch, n).alias(n) for n in needed], *[F.lit(values[c]).alias(c) for c in sorted(consts)])
            out = df if out is None else out.unionByName(df)
        if out is None:
            raise RequestError("no branch of the view matches its constants")
        return out, True

    def _where(self, df: DataFrame, r: Resolved, fact: FactTable, filters: list[Filter], named: bool, times: bool = True) -> DataFrame:
        tests = []
        if not times:
            pass
        elif fact.time_column:
            zone = r.request.parameters.get("TimeZone")
            kind = "date" if dict(df.dtypes).get(fact.time_column) == "date" else "timestamp"
            tests.append(within(F.col(fact.time_column), windows(r.request, zone), kind))
        elif fact.day_column:
            col = fact.column(fact.day_column)
            f = Filter("Between" if r.request.day.op == "Between" else "In", fact.day_column, r.request.day.values)
            if f.op == "In" and col.day_format:
                f = Filter("Between", fact.day_column, (min(map(str, f.values)), max(map(str, f.values))))
            tests.append(column_predicate(f, col, raw_column(fact, fact.day_column, named), is_day=f.op == "Between"))

        def leaf(f: Filter) -> Column:
            col = fact.column(f.field)
            other = raw_column(fact, f.compare_to, named) if f.compare_to else None
            return column_predicate(f, col, raw_column(fact, f.field, named), is_day=f.field == fact.day_column, other=other)

        tests += [combined(f, leaf) for f in filters]
        test = all_of(tests)
        return df if test is None else df.where(test)

    # Dimensions -----------------------------------------------------------------------------------------------------

    def dim_rows(self, name: str, filters: list[Filter], columns: set[str]) -> DataFrame:
        """The dimension's filtered rows with `columns`, named d_<dimension>_<column>."""
        public = self.registry.dims[name]
        t: DimTable = bound(public.table, self.context)
        df = self.table(t.table or t.name)

        def leaf(f: Filter) -> Column:
            col = t.column(f.field)
            if col is None:
                raise RequestError(f"{name} has no column {f.field}")
            return column_predicate(f, col, raw_column(t, f.field), other=raw_column(t, f.compare_to) if f.compare_to else None)

        own = with_forced(with_forced(filters, t.forced_filters), public.forced_filters)
        if look := self.looking(t, columns | {n for f in own for n in f.fields()}):
            df = self.attached(df, look, lambda c: raw_column(t, c.lookup.key))
        test = all_of(combined(f, leaf) for f in own)
        if test is not None:
            df = df.where(test)
        if t.snapshot_column:  # the latest of each key, among what the filters leave
            # A join with the keys' maxima, which have partial sums and a join that can be split where a key is hot.
            key = raw_column(t, t.key)
            latest = df.groupBy(key.alias("_of")).agg(F.max(t.snapshot_column).alias("_latest"))
            df = df.join(latest, key.eqNullSafe(F.col("_of")) & (F.col(t.snapshot_column) == F.col("_latest"))).drop("_of", "_latest")
        return df.select(*[self.shown(t.column(c), raw_column(t, c)).alias(f"d_{name}_{c}") for c in sorted(columns)])

    @staticmethod
    def shown(col: DimCol, c: Column) -> Column:
        c = mapped(c, col.type)
        if isinstance(col.type, DateType):
            return c.cast("date") if not col.type.format else F.date_format(c, col.type.format)
        return F.date_format(c, col.type.format) if isinstance(col.type, TimestampType) and col.type.format else c

    def _dim_columns(self, r: Resolved) -> dict[str, set[str]]:
        """What is needed of each dimension: its key, shown columns, and keys of the next ones."""
        out = {s.dim: {self.registry.dims[s.dim].table.key} for s in r.steps}
        for i in r.items:
            if i.kind == "dim":
                out.setdefault(i.dim, {self.registry.dims[i.dim].table.key}).add(i.column)
        for s in r.steps:
            if s.via:
                out[s.via].add(self.registry.dims[s.via].table.foreign_keys[s.dim])
                for c in self._partitions(s.via, s.dim):
                    out[s.via].add(c)
                    out[s.dim].add(c)
        return out

    def _partitions(self, one: str, other: str) -> list[str]:
        """Partition columns that both dimensions have: they are joined on too, which prunes partitions of either."""
        a, b = (self.registry.dims[d].table for d in (one, other))
        return [c.name for c in a.columns if c.partition and (x := b.column(c.name)) is not None and x.partition]

    def _joined(self, df: DataFrame, r: Resolved, key: Callable[[str], Column], how: str, skip: str = "") -> DataFrame:
        """df with the steps' dimensions; key: the fact's key of a dimension."""
        need = self._dim_columns(r)
        for s in r.steps:
            if s.dim == skip:
                continue
            own = self.dim_rows(s.dim, r.dim_filters.get(s.dim, []), need[s.dim])
            pk = F.col(f"d_{s.dim}_{self.registry.dims[s.dim].table.key}")
            fk = key(s.dim) if not s.via else F.col(f"d_{s.via}_{self.registry.dims[s.via].table.foreign_keys[s.dim]}")
            on = fk == pk
            for c in self._partitions(s.via, s.dim) if s.via else ():
                on = on & (F.col(f"d_{s.via}_{c}") == F.col(f"d_{s.dim}_{c}"))
            df = df.join(own, on, how)
        return df

    # Requests -------------------------------------------------------------------------------------------------------

    def frame(self, r: Resolved, only_keys: list[tuple[str, DataFrame]] = ()) -> DataFrame:
        """The result.  only_keys: (column of the fact, one-column DataFrame of the values that it may have)."""
        self.context = r.request.parameters
        if r.dimension_driven:
            out, paged = self._dimension_driven(r)
        else:
            out, paged = self._fact_driven(r, only_keys)
        return self._finish(out, r, paged)

    def groups(self, r: Resolved) -> DataFrame:
        """One row: how many rows the request has without paging."""
        from dataclasses import replace

        bare = replace(r, request=r.request.with_(start=0, rows=-1, row_count=False), sort=[])
        return self.frame(bare).agg(F.count(F.lit(1)).alias(TOTAL))

    def _keys(self, r: Resolved) -> dict[str, Column]:
        """Shown columns of the fact, by their name in the result."""
        out = {}
        for i in r.items:
            if i.kind == "fact_dim":
                col = r.fact.column(i.column)
                if not col.aggregate:
                    out[i.name] = self.shown(col, raw_column(r.fact, i.column, bool(r.fact.views)))
        return out

    def _needed(self, r: Resolved) -> set[str]:
        """Base columns that a view's branches give."""
        fact, out = r.fact, set()

        def add(name: str) -> None:
            col = fact.column(name)
            if col is None or name in out:
                return
            for u in col.uses:
                add(u)
            if isinstance(col, DimCol) and col.lookup:
                add(col.lookup.key)
                return
            if col.expr is None:
                out.add(name)
            exprs = [col.expr, getattr(getattr(col, "rollup", None), "expr", None)]
            for e in exprs:
                if isinstance(e, str):
                    for n in references(e):
                        add(n)
            rollup = getattr(col, "rollup", None)
            for f in (*getattr(rollup, "filters", ()), *getattr(rollup, "where", ())):
                for n in f.fields():
                    add(n)
            if c := getattr(rollup, "column", None):
                add(c)

        for i in r.items:
            if i.kind in ("fact_dim", "metric"):
                add(i.column)
        for f in (*r.having, *r.fact_filters):
            for n in f.fields():
                add(n)
        for d, c in fact.foreign_keys.items():
            if d in {s.dim for s in r.steps} | set(r.semi):
                add(c)
        return out

    def _metrics(self, r: Resolved, named: bool) -> tuple[Metrics, dict[str, Column], list[Column]]:
        m = Metrics(r.fact, named)
        finals = {i.name: m.final(i.column) for i in r.items if i.kind == "metric"}
        for i in r.items:  # aggregates that are declared as dimensions
            if i.kind == "fact_dim" and (col := r.fact.column(i.column)).aggregate:
                finals[i.name] = m._custom(col.expr)
        having = [combined(f, lambda x: predicate(x, m.final(x.field), r.fact.column(x.field).type, other=m.final(x.compare_to) if x.compare_to else None)) for f in r.having]
        return m, finals, having

    def _fact_driven(self, r: Resolved, only_keys) -> tuple[DataFrame, bool]:
        fact = r.fact
        rows, named = self.rows(r, fact, self._needed(r) | {c for c, _ in only_keys})
        for d in r.semi:
            key = self.registry.dims[d].table.key
            rows = rows.join(self.dim_rows(d, r.dim_filters[d], {key}), raw_column(fact, fact.foreign_keys[d], named) == F.col(f"d_{d}_{key}"), "left_semi")
        for column, values in only_keys:
            rows = rows.join(values.toDF("_only"), raw_column(fact, column, named) == F.col("_only"), "left_semi")
        shown = self._keys(r)
        m, finals, having = self._metrics(r, named) if r.request.query_type != "scan" else (None, {}, [])
        look, later = r.looking
        nested = bool(look) and m is not None and m.mergeable
        if look and not nested:
            rows = self.attached(rows, look, lambda c: raw_column(fact, c.lookup.key, named))
            rows = self._where(rows, r, fact, later, named, times=False)
        if m is None:
            return self._scan(r, rows, shown, named), False
        first = [s.dim for s in r.steps if not s.via]
        fks = {f"fk_{d}": raw_column(fact, fact.foreign_keys[d], named) for d in first}
        key_shown = {i.column for i in r.items if i.kind == "fact_dim"} | {fact.foreign_keys.get(i.dim) for i in r.items if i.kind == "dim" and i.column == self.registry.dims[i.dim].table.key}
        again = any(fact.foreign_keys[d] not in key_shown for d in first)
        how = r.join
        key = lambda d: F.col(f"fk_{d}")
        if again and not m.mergeable:  # join first, aggregate once
            keys = [c.alias(n) for n, c in {**fks, **{f"k_{n}": c for n, c in shown.items()}}.items()]
            groups = [F.col(f"k_{n}").alias(n) for n in shown] + self._dim_items(r)
            if m.countable:  # distinct values are grouped by below the join, and counted above it
                by, partial = [*keys, *m.values()], m.partial()
                held = self._joined(rows.groupBy(*by).agg(*partial) if partial else rows.select(*by).distinct(), r, key, how)
                out = held.groupBy(*groups).agg(*m.counted()) if groups else held.agg(*m.counted())
                return self._projected(out, r, finals, having), False
            held = self._joined(rows.select("*", *keys), r, key, how)
            out = held.groupBy(*groups).agg(*m.aggregates()) if groups else held.agg(*m.aggregates())
            return self._projected(out, r, finals, having), False
        groups = [c.alias(n) for n, c in {**fks, **shown}.items()]
        aggregates = m.aggregates()
        if nested:
            out = self._nested(rows, r, fks, shown, m, named)
        elif aggregates:
            out = rows.groupBy(*groups).agg(*aggregates) if groups else rows.agg(*aggregates)
        else:
            out = rows.select(*groups).distinct()
        if not r.steps:
            return self._projected(out, r, finals, having), False
        if not again and how == "left" and self._page_first(r, set(shown) | set(finals)):
            test = all_of(having)
            out = out if test is None else out.where(test)
            out = out.select("*", *[c.alias(f"_s_{n}") for n, c in finals.items() if n in dict(r.sort)])
            out = self._paged(out.orderBy(*[self._order(f"_s_{n}" if n in finals else n, down) for n, down in r.sort]), r)
            return self._projected(self._joined(out, r, key, how), r, finals, []), True
        out = self._joined(out, r, key, how)
        if again:
            groups = [F.col(n) for n in shown] + self._dim_items(r)
            out = out.groupBy(*groups).agg(*m.again()) if m.primitives and groups else out.agg(*m.again()) if m.primitives else out.select(*groups).distinct()
            return self._projected(out, r, finals, having, dims_named=True), False
        return self._projected(out, r, finals, having), False

    def _nested(self, rows: DataFrame, r: Resolved, fks: dict[str, Column], shown: dict[str, Column], m: Metrics, named: bool) -> DataFrame:
        """Grouped by the keys of the lookups first, looked up and filtered then, and grouped again by what is shown."""
        fact, (look, later) = r.fact, r.looking
        of = {i.name: i.column for i in r.items if i.kind == "fact_dim"}
        late = {c.name for c in look}
        after = {n for n in shown if {c.name for c in self.looking(fact, [of[n]])} & late}
        # What is derived of a lookup, and tests of one, need their other columns until then.
        rest = {x for n in after for x in self._bases(fact, of[n])} | {x for f in later for n in f.fields() for x in self._bases(fact, n)}
        keys = {f"_key_{c.lookup.key}": raw_column(fact, c.lookup.key, named) for c in look}
        bases = {b: F.col(b) for b in sorted(rest)}
        groups = [c.alias(n) for n, c in {**fks, **{n: c for n, c in shown.items() if n not in after}, **keys, **bases}.items()]
        aggregates = m.aggregates()
        part = rows.groupBy(*groups).agg(*aggregates) if aggregates else rows.select(*groups).distinct()
        part = self.attached(part, look, lambda c: F.col(f"_key_{c.lookup.key}"))
        part = self._where(part, r, fact, later, named, times=False)
        groups = [F.col(n) for n in fks] + [(shown[n].alias(n) if n in after else F.col(f"`{n}`")) for n in shown]
        if not aggregates:
            return part.select(*groups).distinct()
        return part.groupBy(*groups).agg(*m.again()) if groups else part.agg(*m.again())

    @staticmethod
    def _bases(fact: FactTable, name: str) -> set[str]:
        """Physical columns that a column's expression reads beside lookups."""
        out, col = set(), fact.column(name)
        if col is None:
            return {name}
        if col.lookup or col.const is not None:
            return out
        if isinstance(col.expr, str):
            for n in references(col.expr):
                out |= Planner._bases(fact, n) if n != name else {n}
        elif col.expr is None:
            out.add(col.source or col.name)
        return out

    @staticmethod
    def _page_first(r: Resolved, own: set[str]) -> bool:
        """Whether the page is decided by columns of one side, so that only its rows need the join."""
        q = r.request
        return bool(r.sort) and q.rows > 0 and not r.outer and not q.row_count and all(n in own for n, _ in r.sort)

    def _scan(self, r: Resolved, rows: DataFrame, shown: dict[str, Column], named: bool) -> DataFrame:
        """Rows as they are; no sorting, no joins, no derived metrics."""
        if r.sort or r.steps or r.having:
            raise RequestError("a scan has no sorting, dimensions or filters on metrics")
        out = []
        for i in r.items:
            if i.kind == "metric":
                col = r.fact.column(i.column)
                if col.expr is not None or not isinstance(col.rollup, str):
                    raise RequestError(f"{i.name} is derived, which a scan can't show")
                out.append(raw_column(r.fact, i.column, named).alias(i.name))
            else:
                out.append(shown[i.name].alias(i.name) if i.kind == "fact_dim" else F.lit(i.value).alias(i.name))
        return rows.select(*out)

    def _dim_items(self, r: Resolved) -> list[Column]:
        return [F.col(f"d_{i.dim}_{i.column}").alias(i.name) for i in r.items if i.kind == "dim"]

    def _projected(self, df: DataFrame, r: Resolved, finals: dict[str, Column], having: list[Column], dims_named: bool = False) -> DataFrame:
        test = all_of(having)
        if test is not None:
            df = df.where(test)
        out = []
        for i in r.items:
            if i.kind == "const":
                out.append(F.lit(i.value).alias(i.name))
            elif i.name in finals:
                out.append(finals[i.name].alias(i.name))
            elif i.kind == "dim" and f"d_{i.dim}_{i.column}" in df.columns and not dims_named:
                out.append(F.col(f"d_{i.dim}_{i.column}").alias(i.name))
            else:
                out.append(F.col(f"`{i.name}`").alias(i.name))
        return df.select(*out)

    def _dimension_driven(self, r: Resolved) -> tuple[DataFrame, bool]:
        need = self._dim_columns(r)
        own = self.dim_rows(r.driving, r.dim_filters.get(r.driving, []), need[r.driving])
        dims = self._joined(own, r, lambda d: F.col(""), "inner", skip=r.driving)
        key_name = f"d_{r.driving}_{self.registry.dims[r.driving].table.key}"
        items = self._dim_items(r)
        if r.fact is None:
            out = self._projected(dims, r, {}, [])
            return (out.distinct() if r.request.parameters.get("Distinct") or r.request.query_type == "groupby" else out), False
        fact = r.fact
        rows, named = self.rows(r, fact, self._needed(r) | set(fact.foreign_keys.values()))
        look, later = r.looking
        if look:
            rows = self._where(self.attached(rows, look, lambda c: raw_column(fact, c.lookup.key, named)), r, fact, later, named, times=False)
        m, finals, having = self._metrics(r, named)
        shown = self._keys(r)
        has_key = any(i.kind == "dim" and i.dim == r.driving and i.column == self.registry.dims[r.driving].table.key for i in r.items)
        paged = False
        dim_names = {i.name for i in r.items if i.kind == "dim"}
        if has_key and r.join == "right" and not shown and self._page_first(r, dim_names):
            by = {i.name: f"d_{i.dim}_{i.column}" for i in r.items if i.kind == "dim"}
            dims, paged = self._paged(dims.orderBy(*[self._order(by[n], down) for n, down in r.sort]), r), True
        path = self.registry.path(set(fact.foreign_keys), r.driving)
        near = path[0][0]
        fk = raw_column(fact, fact.foreign_keys[near], named)
        if paged and len(path) == 1:  # only facts of the page
            rows = rows.join(dims.select(F.col(key_name).alias("_page")), fk == F.col("_page"), "left_semi")
        groups = [fk.alias("_fk"), *[c.alias(n) for n, c in shown.items()]]
        how = "left" if r.join == "right" else "inner"
        if not has_key and m.countable and not m.mergeable:  # distinct values are grouped by below the join, and counted above it
            by, partial = [*groups, *m.values()], m.partial()
            held = self._climb(rows.groupBy(*by).agg(*partial) if partial else rows.select(*by).distinct(), path)
            out = dims.join(held, F.col(key_name) == F.col("_fk"), how).groupBy(*[F.col(n) for n in shown], *items).agg(*m.counted())
            return self._projected(out, r, finals, having, dims_named=True), False
        if len(path) > 1 and not m.mergeable:
            held = rows.select("*", *groups)
            held = self._climb(held, path)
            agg = held.groupBy("_fk", *shown).agg(*m.aggregates())
        else:
            agg = rows.groupBy(*groups).agg(*m.aggregates()) if m.primitives else rows.select(*groups).distinct()
            if len(path) > 1:
                agg = self._climb(agg, path)
                agg = agg.groupBy("_fk", *shown).agg(*m.again()) if m.primitives else agg.distinct()
        out = dims.join(agg, F.col(key_name) == F.col("_fk"), how)
        if not has_key:
            if m.primitives and m.mergeable:
                out = out.groupBy(*[F.col(n) for n in shown], *items).agg(*m.again())
                return self._projected(out, r, finals, having, dims_named=True), False
            if m.primitives:
                raise RequestError(f"a metric of this request can't be aggregated again: select the key of {r.driving}")
        return self._projected(out, r, finals, having), paged

    def _climb(self, df: DataFrame, path: list[tuple[str, str]]) -> DataFrame:
        """_fk of the first dimension of a path becomes that of the last."""
        for (d, _), (nxt, _) in zip(path, path[1:], strict=False):
            t = self.registry.dims[d].table
            link = self.table(t.table or t.name).select(raw_column(t, t.key).alias("_pk"), raw_column(t, t.foreign_keys[nxt]).alias("_next"))
            df = df.join(link, F.col("_fk") == F.col("_pk"), "inner").drop("_fk", "_pk").withColumnRenamed("_next", "_fk")
        return df

    # Result ---------------------------------------------------------------------------------------------------------

    @staticmethod
    def _order(name: str, down: bool) -> Column:
        """Nulls come last in either direction."""
        return F.col(f"`{name}`").desc_nulls_last() if down else F.col(f"`{name}`").asc_nulls_last()

    @staticmethod
    def _paged(df: DataFrame, r: Resolved) -> DataFrame:
        q = r.request
        if q.start:
            df = df.offset(q.start)
        return df.limit(q.rows) if q.rows > 0 else df

    def _finish(self, df: DataFrame, r: Resolved, paged: bool) -> DataFrame:
        if r.outer:
            by = {i.name: i for i in r.items}

            def leaf(f: Filter) -> Column:
                return predicate(f, F.col(f"`{f.field}`"), self._type(r, by[f.field]), other=F.col(f"`{f.compare_to}`") if f.compare_to else None)

            df = df.where(all_of(combined(f, leaf) for f in r.outer))
        if r.request.row_count:
            # A scalar subquery, and no window over everything, which would bring all rows into one task.
            df = df.withColumn(TOTAL, df.agg(F.count(F.lit(1))).scalar())
        if r.sort:
            df = df.orderBy(*[self._order(n, down) for n, down in r.sort])
        df = df if paged else self._paged(df, r)
        if r.request.parameters.get("RowNumber"):
            # Rows of a page, which is bounded, are numbered in one task; all rows would be.
            if r.request.rows <= 0 or not r.sort:
                raise RequestError("rows are numbered on a sorted page")
            w = Window.orderBy(*[self._order(n, down) for n, down in r.sort])
            df = df.withColumn(ROWNUM, (F.row_number().over(w) + r.request.start).cast("bigint"))
        return self._posted(df, r)

    def _posted(self, df: DataFrame, r: Resolved) -> DataFrame:
        """Functions on the rows of the result: they see the page's values, after sorting and paging by those."""
        at = {i.column: i.name for i in r.items if i.column}
        changes = {}
        for i in r.items:
            col = self._column(r, i)
            if col is not None and isinstance(col.post, str):
                own = lambda n, i=i: F.col(f"`{i.name}`") if n == "value" else F.col(f"`{at[n]}`") if n in at else F.lit(None)
                changes[i.name] = parse(col.post, own)
        return df.withColumns(changes) if changes else df

    def _column(self, r: Resolved, i: Item):
        if i.kind == "dim":
            return bound(self.registry.dims[i.dim].table, self.context).column(i.column)
        return r.fact.column(i.column) if i.kind in ("fact_dim", "metric") else None

    def _type(self, r: Resolved, i: Item):
        if i.kind == "dim":
            return self.registry.dims[i.dim].table.column(i.column).type
        return r.fact.column(i.column).type
