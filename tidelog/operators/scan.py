"""Ordered scans: ranges, prefixes, seeks, reverse and limits.  Key predicates are plain comparisons, so files see them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import successor


def between(df: DataFrame, begin=None, end=None) -> DataFrame:
    """Keys in [begin, end)."""
    df = df if begin is None else df.filter(F.col("key") >= F.lit(begin))
    return df if end is None else df.filter(F.col("key") < F.lit(end))


def with_prefix(df: DataFrame, prefix) -> DataFrame:
    """As a range, which is pushed down for binary keys too."""
    return between(df, prefix, successor(prefix)) if len(prefix) else df


def seek_prefix(df: DataFrame, target, n: int, fixed: bool = True) -> DataFrame:
    """From target on, inside its prefix of n; a target out of a fixed prefix's domain has no bound."""
    df = between(df, target)
    return df if fixed and len(target) < n else with_prefix(df, target[:n])


def ordered(df: DataFrame, reverse: bool = False, limit: int | None = None) -> DataFrame:
    df = df.orderBy(F.col("cf"), F.col("key").desc() if reverse else F.col("key"))
    return df if limit is None else df.limit(limit)


def seek(df: DataFrame, target, limit: int | None = None) -> DataFrame:
    """The first visible keys at or above target."""
    return ordered(between(df, target), limit=limit)


def seek_for_prev(df: DataFrame, target, limit: int | None = None) -> DataFrame:
    """The last visible keys at or below target, downwards."""
    return ordered(df.filter(F.col("key") <= F.lit(target)), reverse=True, limit=limit)


def merged(*runs: DataFrame) -> DataFrame:
    """All rows of sorted runs, none dropped, in internal order."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.orderBy("cf", "key", F.col("seq").desc())
