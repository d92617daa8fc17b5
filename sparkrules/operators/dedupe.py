"""Duplicate events by a composite key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable(df: DataFrame, *skip: str) -> list[Column]:
    """The columns that can break a tie: those without maps or variants."""
    return [F.col(f"`{c}`") for c, kind in df.dtypes if c not in skip and not any(x in kind for x in ("map<", "variant", "void"))]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that agree in all keys the first in ``order``; rows with a null key are never duplicates.

    Rows are combined before the shuffle, so a key that many rows share costs its task one row a partition.
    """
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    row = F.struct(*[f"`{c}`" for c in df.columns])
    kept = df.where(known).groupBy(*keys).agg(F.min_by(row, F.struct(*order, *comparable(df, *keys, *order))).alias("__row")).select("__row.*")
    return kept.select(*[f"`{c}`" for c in df.columns]).unionByName(df.where(~known))


def within_ttl(stream: DataFrame, keys: list[str], time: str, ttl: str) -> DataFrame:
    """For streams: a key's later events are dropped for ``ttl`` (such as "10 minutes"); rows with a null key pass."""
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    timed = stream.withWatermark(time, ttl)
    return timed.where(known).dropDuplicatesWithinWatermark(keys).unionByName(timed.where(~known))
