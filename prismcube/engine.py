"""The engine: a registry of cubes over tables that Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions.lookup import Namespace
from .model import Registry
from .plans.lower import Planner
from .plans.resolve import Resolved, resolve
from .plans.select import Buckets, Preference
from .request import Request, from_json


class Engine:
    """today: the day that look-back guards count from, a function so that it can be set; listeners: called with
    (request, resolved) when a request has been planned; transformers: called with (result, resolved), each giving the
    result on, for what an application does to every result; namespaces: for columns that are looked up."""

    def __init__(
        self, spark: SparkSession, registry: Registry, source: Callable[[str], DataFrame], *, schema: str = "default", today: Callable[[], date] = date.today,
        preference: Preference | None = None, estimate=None, buckets: Mapping[str, Buckets] | None = None, listeners: tuple[Callable[[Request, Resolved], None], ...] = (),
        namespaces: Mapping[str, Namespace] | Callable[[str], Namespace] | None = None, transformers: tuple[Callable[[DataFrame, Resolved], DataFrame], ...] = (),
    ):
        self.spark, self.registry, self.schema, self.today = spark, registry, schema, today
        self.preference, self.estimate, self.buckets, self.listeners = preference, estimate, dict(buckets or {}), listeners
        self.transformers = transformers
        self.planner = Planner(spark, registry, source, namespaces.__getitem__ if isinstance(namespaces, Mapping) else namespaces)

    def resolve(self, request: Request | Mapping[str, Any] | str) -> Resolved:
        request = request if isinstance(request, Request) else from_json(request)
        if request.revision is None and request.cube in self.buckets:
            user = str(request.parameters.get("UserId", ""))
            request = request.with_(revision=self.buckets[request.cube].choose(user, str(request.parameters.get("RequestId", "")))[0])
        return resolve(self.registry, request, schema=self.schema, today=self.today(), preference=self.preference, estimate=self.estimate)

    def frame(self, request, only_keys=()) -> DataFrame:
        """The result of one request, without its curators."""
        r = self.resolve(request)
        for listen in self.listeners:
            listen(r.request, r)
        if r.request.query_type == "rowcount":
            return self.planner.groups(r)
        out = self.planner.frame(r, only_keys)
        for change in self.transformers:
            out = change(out, r)
        return out

    def execute(self, request) -> dict[str, DataFrame]:
        """The results of the request's curators, by name."""
        from .curators import coordinate

        return coordinate(self, request)

    def sql(self, text: str) -> DataFrame:
        """SELECT from a cube, or DESCRIBE, in the restricted dialect of `sqlfront`."""
        from .sqlfront import describe, parse_sql

        parsed = parse_sql(text, self.registry, today=self.today())
        return describe(self.spark, self.registry, parsed) if isinstance(parsed, str) else self.frame(parsed)
