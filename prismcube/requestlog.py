"""A log of requests: one record for each that was planned, as a listener of the engine.

Records are small (names and numbers, never rows), held up to `size` and written then, as JSON lines or to whatever sink
Spark writes; a topic takes them as messages.
"""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .plans.resolve import Resolved
from .request import Request, day_range

SCHEMA = "request_id string, user_id string, time double, cube string, revision int, table string, engine string, driven_by string, fields array<string>, filters array<string>, first_day string, last_day string, start int, rows int, estimated_rows bigint, curators array<string>, json string"


def record(request: Request, r: Resolved) -> dict[str, Any]:
    first, last = day_range(request.day)
    best = r.choice[0] if r.choice else None
    return {
        "request_id": str(request.parameters.get("RequestId", "")), "user_id": str(request.parameters.get("UserId", "")), "time": time.time(), "cube": request.cube, "revision": r.cube.revision,
        "table": r.fact.name if r.fact else None, "engine": r.fact.engine if r.fact else None, "driven_by": r.driving if r.dimension_driven else "fact", "fields": [f.field for f in request.fields],
        "filters": [f"{x} {f.op}" for f in request.filters for x in sorted(f.fields())], "first_day": first.isoformat(), "last_day": last.isoformat(), "start": request.start, "rows": request.rows,
        "estimated_rows": best.rows if best else None, "curators": sorted(request.curators), "json": json.dumps({k: str(v) for k, v in request.parameters.items()}, sort_keys=True),
    }


class RequestLog:
    """Give it to the engine as a listener."""

    def __init__(self, spark: SparkSession, *, path: str | None = None, format: str = "json", size: int = 1000, **options: str):
        self.spark, self.path, self.format, self.size, self.options = spark, path, format, size, options
        self.records: list[dict[str, Any]] = []

    def __call__(self, request: Request, resolved: Resolved) -> None:
        self.records.append(record(request, resolved))
        if self.path and len(self.records) >= self.size:
            self.flush()

    def frame(self) -> DataFrame:
        """What is held."""
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in self.records], SCHEMA)

    def flush(self) -> None:
        """Writes what is held and forgets it."""
        if self.records and self.path:
            self.frame().coalesce(1).write.format(self.format).options(**self.options).mode("append").save(self.path)
            self.records = []
