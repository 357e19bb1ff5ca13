"""A restricted SQL over cubes: SELECT ... FROM cube [WHERE] [HAVING] [ORDER BY] [OFFSET] [FETCH | LIMIT], and DESCRIBE cube.

Columns are aliases in double quotes; `*` stands for all metrics, then all dimensions.  WHERE and HAVING both become
filters of the request, which go where their fields belong.  Without a Day filter the last seven days are meant.  What
can't be expressed is an error: nothing is left out silently.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from .model import Registry
from .operators.filters import Filter
from .request import Field, Request, RequestError, SortBy

_TOKEN = re.compile(r"""\s*(?:"((?:[^"]|"")*)"|'((?:[^']|'')*)'|(\d+\.?\d*|-\d+\.?\d*)|(<>|!=|>=|<=|[=<>(),*])|([A-Za-z_][\w.]*))""")
DAYS = 7


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, i = text.strip().rstrip(";"), [], 0
        while i < len(self.text):
            m = _TOKEN.match(self.text, i)
            if not m:
                raise RequestError(f"can't read {self.text[i:]!r}")
            quoted, string, number, sign, word = m.groups()
            kind, value = ("name", quoted.replace('""', '"')) if quoted is not None else ("value", string.replace("''", "'")) if string is not None else ("value", number) if number is not None else ("sign", sign) if sign else ("word", word)
            self.tokens.append((kind, value))
            i = m.end()
        self.at = 0

    def word(self) -> str:
        return self.tokens[self.at][1].upper() if self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign") else ""

    def accept(self, *words: str) -> bool:
        for n, w in enumerate(words):
            k = self.at + n
            if k >= len(self.tokens) or self.tokens[k][0] not in ("word", "sign") or self.tokens[k][1].upper() != w:
                return False
        self.at += len(words)
        return True

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise RequestError(f"expected {' '.join(words)} at {self.tokens[self.at : self.at + 3]}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in ("name", "word"):
            raise RequestError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "value":
            raise RequestError("a value is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]


def _condition(r: _Reader) -> Filter:
    out = [_conjunction(r)]
    while r.accept("OR"):
        out.append(_conjunction(r))
    if len(out) == 1:
        return out[0]
    flat = [c for f in out for c in (f.children if f.op == "Or" else (f,))]
    return Filter("Or", children=tuple(flat))


def _conjunction(r: _Reader) -> Filter:
    out = [_test(r)]
    while r.accept("AND"):
        out.append(_test(r))
    if len(out) == 1:
        return out[0]
    return Filter("And", children=tuple(c for f in out for c in (f.children if f.op == "And" else (f,))))


def _test(r: _Reader) -> Filter:
    if r.accept("("):
        out = _condition(r)
        r.expect(")")
        return out
    name = r.name()
    if r.accept("IS", "NOT", "NULL"):
        return Filter("IsNotNull", name)
    if r.accept("IS", "NULL"):
        return Filter("IsNull", name)
    negated = r.accept("NOT")
    if r.accept("IN"):
        r.expect("(")
        values = [r.value()]
        while r.accept(","):
            values.append(r.value())
        r.expect(")")
        return Filter("Not In" if negated else "In", name, tuple(values))
    if r.accept("LIKE"):
        return Filter("Not Like" if negated else "Like", name, (_contained(r.value()),))
    if negated:
        raise RequestError(f"NOT can't be used on {name} so")
    if r.accept("BETWEEN"):
        lo = r.value()
        r.expect("AND")
        return Filter("Between", name, (lo, r.value()))
    for sign, op in (("=", "="), ("<>", "<>"), ("!=", "<>"), (">=", ">="), ("<=", "<="), (">", ">"), ("<", "<")):
        if r.accept(sign):
            if r.at < len(r.tokens) and r.tokens[r.at][0] == "name":
                if op != "=":
                    raise RequestError(f"{op} between two columns isn't supported")
                return Filter("==", name, compare_to=r.name())
            return Filter(op, name, (r.value(),))
    raise RequestError(f"no test of {name}")


def _times(parts: list[Filter], today: date) -> tuple[Filter, Filter | None, Filter | None, list[Filter]]:
    """Day, Hour and Minute filters out of the conjunction; one-sided bounds of the day are put together."""
    rest, found, bounds = [], {}, {}
    for f in parts:
        if f.field == "Day" and f.op in (">=", "<="):
            bounds[f.op] = f.values[0]
        elif f.field in ("Day", "Hour", "Minute") and f.op in ("=", "In", "Between"):
            if f.field in found:
                raise RequestError(f"{f.field} is filtered twice")
            found[f.field] = f
        elif f.op in (">=", "<="):
            raise RequestError(f"{f.op} is for Day only: use > or < on {f.field}")
        elif f.children and f.fields() & {"Day", "Hour", "Minute"}:
            raise RequestError("Day, Hour and Minute can't be part of an OR")
        else:
            rest.append(f)
    if bounds:
        if "Day" in found:
            raise RequestError("Day is filtered twice")
        hi = bounds.get("<=", today.isoformat())
        found["Day"] = Filter("Between", "Day", (bounds.get(">=", (date.fromisoformat(hi) - timedelta(DAYS)).isoformat()), hi))
    day = found.get("Day") or Filter("Between", "Day", ((today - timedelta(DAYS)).isoformat(), today.isoformat()))
    return day, found.get("Hour"), found.get("Minute"), rest


def _call(r: _Reader) -> tuple[str, dict]:
    """LOOKUP("field", 'namespace', 'column'[, 'missing'][, 'a->b,...' values][, 'a->b,...' keys])."""
    r.name()
    r.expect("(")
    field, args = r.name(), []
    while r.accept(","):
        args.append(r.value())
    r.expect(")")
    if not 2 <= len(args) <= 5:
        raise RequestError(f"a lookup of {field} takes three to six arguments")
    pairs = lambda s: tuple(tuple(x.split("->", 1)) for x in s.split(",") if x)
    args += [""] * (5 - len(args))
    return field, {"namespace": args[0], "value": args[1], "missing": args[2] or None, "values": pairs(args[3]), "keys": pairs(args[4])}


def _contained(pattern: str) -> str:
    """The value of a pattern '%value%'; other patterns can't be expressed."""
    inner = pattern[1:-1]
    if len(pattern) < 2 or pattern[0] != "%" or pattern[-1] != "%" or "%" in inner or "_" in inner:
        raise RequestError(f"LIKE takes '%value%' only, without % or _ in it: {pattern}")
    return inner


def parse_sql(text: str, registry: Registry, *, today: date) -> Request | str:
    """The request of a SELECT; of a DESCRIBE, the cube's name."""
    r = _Reader(text)
    if r.accept("DESCRIBE"):
        r.accept("TABLE")
        return r.name().split(".")[-1].lower()
    r.expect("SELECT")
    if r.accept("DISTINCT"):
        raise RequestError("DISTINCT isn't supported: groups are distinct")
    fields: list[Field] = []
    star = r.accept("*")
    while not star:
        if r.word().endswith("LOOKUP") and r.at + 1 < len(r.tokens) and r.tokens[r.at + 1][1] == "(":
            name, look = _call(r)
        else:
            name, look = r.name(), None
        alias = r.name() if r.accept("AS") else name
        fields.append(Field(name, alias, lookup=look))
        if not r.accept(","):
            break
    r.expect("FROM")
    cube_name = r.name().split(".")[-1].lower()
    cube = registry.cube(cube_name)
    if cube is None:
        raise RequestError(f"there is no cube {cube_name}")
    if star:
        fields = [Field(c.alias, c.alias) for c in (*cube.metrics, *cube.dims) if not c.hidden and c.alias not in ("Hour", "Minute")]
    parts: list[Filter] = []
    for word in ("WHERE", "HAVING"):
        if r.accept(word):
            f = _condition(r)
            parts += f.children if f.op == "And" else (f,)
    sort = []
    if r.accept("ORDER", "BY"):
        while True:
            name = r.name()
            down = r.accept("DESC")
            if not down:
                r.accept("ASC")
            sort.append(SortBy(name, down))
            if not r.accept(","):
                break
    start, rows = 0, -1
    if r.accept("OFFSET"):
        start = int(r.value())
        r.accept("ROWS") or r.accept("ROW")
    if r.accept("FETCH"):
        r.accept("NEXT") or r.accept("FIRST")
        rows = int(r.value())
        r.accept("ROWS") or r.accept("ROW")
        r.accept("ONLY")
    elif r.accept("LIMIT"):
        rows = int(r.value())
        if r.accept("OFFSET"):
            start = int(r.value())
    if r.at < len(r.tokens):
        raise RequestError(f"unexpected {r.tokens[r.at][1]}")
    day, hour, minute, rest = _times(parts, today)
    return Request(cube_name, tuple(fields), tuple(rest), day, hour, minute, tuple(sort), start, rows)


def describe(spark: SparkSession, registry: Registry, cube_name: str) -> DataFrame:
    """(column, kind, type, operations): what a cube offers."""
    cube = registry.cube(cube_name)
    if cube is None:
        raise RequestError(f"there is no cube {cube_name}")
    fact, rows = cube.facts[0], []
    for kind, cols in (("DIM", cube.dims), ("FACT", cube.metrics)):
        for c in cols:
            own = next((f.column(c.column) for f in cube.facts if f.column(c.column)), None) or fact.column(c.column)
            rows.append((c.alias, kind, own.type.spark if own else "string", ",".join(sorted(c.ops))))
    return spark.createDataFrame(rows, "`column` string, kind string, type string, operations string")
