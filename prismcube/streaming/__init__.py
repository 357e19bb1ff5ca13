"""Lookup tables that a stream of changes keeps up to date: of each key the newest version wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lookup import Namespace


def latest(changes: DataFrame, key: str, updated: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key; an aggregate with partial results, so a hot key isn't gathered.  tie: decides among
    rows of one time, the larger first."""
    rank = F.struct(updated, tie) if tie else F.col(updated)
    held = changes.select(key, F.struct(*changes.columns).alias("_row"), rank.alias("_rank"))
    return held.groupBy(key).agg(F.max_by("_row", "_rank").alias("_row")).select("_row.*")


def merged(table: DataFrame | None, changes: DataFrame, key: str, updated: str, tie: str | None = None) -> DataFrame:
    """The table after the changes; one that is older than what the table has is ignored, as late data is."""
    return latest(changes if table is None else table.unionByName(changes), key, updated, tie)


class LookupStore:
    """Versions of a lookup table in a folder, <path>/v=<load>.<batch>; readers take the last complete one.

    A full load (of a file, a database or a snapshot) begins a new <load>; changes, of a stream or pulled, are batches of
    it, numbered from 1, so that a batch that comes again gives the same version.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, updated: str, tie: str | None = None):
        self.spark, self.path, self.key, self.updated, self.tie = spark, path, key, updated, tie

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[tuple[int, int]]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        done = [x for x in found if x.getName().startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(tuple(map(int, x.getName()[2:].split("."))) for x in done)

    def _at(self, version: tuple[int, int]) -> str:
        return f"{self.path}/v={version[0]}.{version[1]}"

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(self._at(v[-1])) if v else None

    def namespace(self, name: str) -> Namespace:
        """For the lookups of cubes; the version that is the last now."""
        table = self.read()
        if table is None:
            raise ValueError(f"{name} hasn't been loaded")
        return Namespace(name, table, self.key)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Writes the version of a batch of changes."""
        known = self.versions()
        to = (known[-1][0] if known else 0, batch + 1)
        before = [v for v in known if v < to]
        table = self.spark.read.parquet(self._at(before[-1])) if before else None
        merged(table, changes, self.key, self.updated, self.tie).write.mode("overwrite").parquet(self._at(to))

    def refresh(self, full: DataFrame, *, replace: bool = False) -> None:
        """A full load instead of changes, over what is there; replace: keys that it hasn't go."""
        known = self.versions()
        table = self.read() if known and not replace else None
        merged(table, full, self.key, self.updated, self.tie).write.mode("overwrite").parquet(self._at(((known[-1][0] + 1) if known else 0, 0)))

    def pull(self, source: DataFrame) -> int:
        """The rows that changed since the newest one held, in one batch; of a database, it gets that as a predicate.
        Returns how many came; those of the newest time come again, as some may have been written later in it."""
        table = self.read()
        since = table.agg(F.max(self.updated)).first()[0] if table is not None else None
        changes = source if since is None else source.where(F.col(self.updated) >= F.lit(since))
        n = changes.count()
        if n:
            known = self.versions()
            self.apply(changes, known[-1][1] if known else 0)
        return n

    def follow(self, stream: DataFrame, checkpoint: str, *, once: bool = False) -> StreamingQuery:
        """Applies a stream's micro-batches, on top of the last full load."""
        w = stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the last versions."""
        fs, _ = self._fs()
        for v in self.versions()[: -max(keep, 1)]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._at(v)), True)


def incremental(source: DataFrame, updated: str, since, until=None) -> DataFrame:
    """Rows changed after `since`, up to `until`: a predicate that a JDBC source takes over."""
    out = source.where(F.col(updated) > F.lit(since))
    return out if until is None else out.where(F.col(updated) <= F.lit(until))


def missed(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str) -> DataFrame:
    """Distinct keys that the lookup doesn't have, to be published."""
    return df.where(F.col(key).isNotNull()).join(lookup, F.col(key) == F.col(lookup_key), "left_anti").select(key).distinct()


def publish(rows: DataFrame, key: str, *, format: str = "kafka", **options: str) -> None:
    """Rows as messages (key, JSON) for another system: a topic, or any sink that Spark writes."""
    made = rows.select(F.col(f"`{key}`").cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))
    made.write.format(format).options(**options).mode("append").save()
