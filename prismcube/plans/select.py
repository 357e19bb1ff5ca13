"""Choice of the physical table: which can answer, and which does so at the least cost."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import cmp_to_key
from hashlib import sha256

from ..model import Cube, FactTable

UNBOUNDED = (1 << 63) - 1


class RangeLookup:
    """Values of half-open ranges of longs, [(low, high, value)]; ranges don't overlap."""

    def __init__(self, entries: Sequence[tuple[int, int, object]]):
        self.entries = sorted(entries)
        for (_, high, _), (low, _, _) in zip(self.entries, self.entries[1:], strict=False):
            if low < high:
                raise ValueError(f"two ranges hold {low}")
        self._lows = [e[0] for e in self.entries]

    def find(self, key: int):
        k = bisect_right(self._lows, key) - 1
        return self.entries[k][2] if k >= 0 and key < self.entries[k][1] else None


def estimated_rows(fact: FactTable, days: int, estimate: Callable[[FactTable, int], int | None] | None = None) -> int:
    """By an estimator for the grain, or the table's default for each day and one more."""
    own = estimate(fact, days) if estimate else None
    return own if own is not None else fact.default_rows * (days + 1)


def cost(fact: FactTable, rows: int) -> int:
    if fact.cost_multiplier is None:
        return rows
    factor = fact.cost_multiplier.find(rows)
    return UNBOUNDED if factor is None else int(factor * rows)


@dataclass(frozen=True)
class Candidate:
    fact: FactTable
    rows: int
    cost: int


@dataclass(frozen=True)
class Preference:
    """Of engines, by the number of rows: the smaller rank is the better.  high: for requests with a filter that names many keys."""

    ranks: dict[str, RangeLookup] = field(default_factory=dict)
    high: dict[str, RangeLookup] = field(default_factory=dict)

    def rank(self, engine: str, rows: int, high: bool = False) -> int:
        ranks = self.high if high and self.high else self.ranks
        found = ranks[engine].find(rows) if engine in ranks else None
        return UNBOUNDED if found is None else int(found)


def best(candidates: Iterable[Candidate], preference: Preference | None = None, high: bool = False) -> list[Candidate]:
    """Candidates from the best on.  Of one engine: by cost, then the higher rollup level; of different ones by preference first."""

    def compare(a: Candidate, b: Candidate) -> int:
        if a.fact.engine != b.fact.engine and preference:
            x, y = preference.rank(a.fact.engine, a.rows, high), preference.rank(b.fact.engine, b.rows, high)
            if x != y:
                return -1 if x < y else 1
        return (a.cost > b.cost) - (a.cost < b.cost) or (b.fact.level > a.fact.level) - (b.fact.level < a.fact.level)

    return sorted(candidates, key=cmp_to_key(compare))


class KeyIndex:
    """Tables by the exact set of their foreign keys."""

    def __init__(self, facts: Iterable[FactTable]):
        self._by: dict[frozenset[str], list[FactTable]] = {}
        for f in facts:
            self._by.setdefault(frozenset(f.foreign_keys), []).append(f)

    def exact(self, keys: Iterable[str]) -> list[FactTable]:
        return self._by.get(frozenset(keys), [])

    def holding(self, keys: Iterable[str]) -> list[FactTable]:
        want = frozenset(keys)
        return [f for k, fs in self._by.items() if want <= k for f in fs]


def refused(fact: FactTable, *, columns: set[str], keys: set[str], schema: str, grain: str, first: date, last: date, today: date) -> str | None:
    """Why a table can't answer, or None."""
    have = {c.name for c in (*fact.dims, *fact.metrics)}
    if missing := columns - have:
        return f"has no {', '.join(sorted(missing))}"
    if missing := keys - set(fact.foreign_keys):
        return f"has no key of {', '.join(sorted(missing))}"
    if schema not in fact.schemas:
        return f"isn't for schema {schema}"
    if fact.available_from and first < fact.available_from:
        return f"begins on {fact.available_from}"
    if fact.max_window is not None and (last - first).days > fact.max_window:
        return f"answers for {fact.max_window} days at most"
    if fact.max_lookback is not None and (today - first).days > fact.max_lookback:
        return f"looks back {fact.max_lookback} days at most"
    order = ("daily", "hourly", "minute")
    if order.index(grain) > order.index(fact.grain):
        return f"is {fact.grain}"
    return None


def candidates(cube: Cube, days: int, estimate=None, **need) -> tuple[list[Candidate], dict[str, str]]:
    """Tables that can answer, and why others can't."""
    found, why = [], {}
    holding = {f.name for f in KeyIndex(cube.facts).holding(need["keys"])}
    for f in cube.facts:
        if f.name not in holding:
            why[f.name] = f"has no key of {', '.join(sorted(need['keys'] - set(f.foreign_keys)))}"
        elif reason := refused(f, **need):
            why[f.name] = reason
        else:
            rows = estimated_rows(f, days, estimate)
            found.append(Candidate(f, rows, cost(f, rows)))
    return found, why


@dataclass(frozen=True)
class Buckets:
    """Revisions of a cube by percentage of users, with users set by name and a second revision as a dry run."""

    shares: tuple[tuple[int, int], ...]  # (revision, percent)
    users: dict[str, int] = field(default_factory=dict)
    dry_run: tuple[tuple[int, int], ...] = ()

    def __post_init__(self):
        if sum(p for _, p in self.shares) != 100:
            raise ValueError("the percentages of revisions come to 100")

    def _of(self, shares, number: int) -> int | None:
        for revision, percent in shares:
            if number < percent:
                return revision
            number -= percent
        return None

    def choose(self, user: str, request_id: str = "") -> tuple[int, int | None]:
        number = int.from_bytes(sha256(f"{user}|{request_id}".encode()).digest()[:8], "big") % 100
        return self.users[user] if user in self.users else self._of(self.shares, number), self._of(self.dry_run, number)
