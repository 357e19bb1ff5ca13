"""Joins beside those that a request implies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.select import RangeLookup


def with_partitions(left: DataFrame, right: DataFrame, keys: Sequence[str], partitions: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined on the keys and on the partition columns that both sides have, which prunes partitions of either."""
    shared = [p for p in partitions if p in left.columns and p in right.columns]
    return left.join(right, [*keys, *shared], how)


def in_ranges(c: Column, ranges: RangeLookup) -> Column:
    """The value of the range that holds c; null for none.  Of literals, so that nothing is joined."""
    out = None
    for low, high, value in ranges.entries:
        test = (c >= F.lit(low)) & (c < F.lit(high))
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return F.lit(None).cast("string") if out is None else out


def salted(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """A join in which each key of the left side is dealt over `salts` tasks; the right side is repeated as often."""
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted")
    one = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)))
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return one.join(many, [key, "_salt"], how).drop("_salt")
