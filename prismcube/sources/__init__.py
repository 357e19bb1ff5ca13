"""Tables that cubes read: parquet, CSV and TSV, JSON, JDBC and catalog tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class SourceError(ValueError):
    """A source that isn't declared."""


@dataclass(frozen=True)
class Location:
    """format: parquet, csv, json, orc, table or jdbc.  CSV needs a schema: inferring one would read everything twice."""

    format: str
    path: str = ""
    schema: StructType | str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.format == "table":
            return spark.table(self.path)
        reader = spark.read.options(**self.options)
        if self.format in ("csv", "tsv"):
            if self.schema is None:
                raise SourceError(f"{self.path} needs a schema")
            if self.format == "tsv":
                reader = reader.option("sep", "\t")
            return reader.schema(self.schema).csv(self.path)
        if self.schema is not None:
            reader = reader.schema(self.schema)
        return reader.format(self.format).load(self.path) if self.path else reader.format(self.format).load()


def jdbc(url: str, table: str, *, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> Location:
    """A table of a database, read in parts by ranges of a numeric column."""
    split = {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)} if column else {}
    return Location("jdbc", options={"url": url, "dbtable": table, **split, **options})


def folder(spark: SparkSession, path: str) -> Callable[[str], DataFrame]:
    """Tables as <path>/<name>.parquet."""
    return lambda name: spark.read.parquet(f"{path}/{name}.parquet")


def places(spark: SparkSession, at: Mapping[str, Location | DataFrame]) -> Callable[[str], DataFrame]:
    def read(name: str) -> DataFrame:
        if name not in at:
            raise SourceError(f"there is no table {name}")
        found = at[name]
        return found if isinstance(found, DataFrame) else found.read(spark)

    return read


def scratch(spark: SparkSession) -> str:
    """A path that isn't there yet, in the folder that all executors share; one of this machine only in local mode, where none is set."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise SourceError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
    return f"{base}/{uuid.uuid4().hex}"
