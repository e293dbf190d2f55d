"""Which version of each key a reader sees.

A range tombstone acts as a delete at its sequence number for every kind of record, merges included, in gets and
scans alike.  Filters on seq and key stand before every aggregate, so they reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import MergeOperatorNotConfigured
from ..schema import DELETE, MERGE, PUT, RANGE_DELETE, SINGLE_DELETE
from . import tombstones
from .merge import MergeOperator

ENDS = (PUT, DELETE, SINGLE_DELETE)


def at_snapshot(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.filter(F.col("seq") <= snapshot)


def deduped(log: DataFrame) -> DataFrame:
    """After a recovery that replayed records already flushed."""
    return log.dropDuplicates(["cf", "key", "seq"])


def heads(points: DataFrame) -> DataFrame:
    """The newest record of each key."""
    newest = points.groupBy("cf", "key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("h"))
    return newest.select("cf", "key", "h.seq", "h.op", "h.value")


#: Operands of a key are folded by stretches of so many sequences first, so that a hot key is many groups.
STRETCH = 1 << 16


def _fold(points: DataFrame, merge: MergeOperator, by: list[str], operands: Column) -> DataFrame:
    """Of each group: its newest base and what its operands above that fold to."""
    ends = F.when(F.col("op").isin(*ENDS), F.col("seq"))
    used = points.withColumn("base_seq", F.max(ends).over(W.partitionBy(*by))).filter(F.col("base_seq").isNull() | (F.col("seq") >= F.col("base_seq")))
    return used.groupBy(*by).agg(
        F.max("seq").alias("seq"),
        F.max("base_seq").alias("base_seq"),
        F.max(F.when(F.col("op") == PUT, F.struct("value"))).alias("base"),
        F.count(F.when(F.col("op") == MERGE, F.col("value"))).alias("n"),
        operands.alias("operands"),
    )


def folded(points: DataFrame, merge: MergeOperator) -> DataFrame:
    """(cf, key, seq, value): operands above the newest base, folded over it; keys whose newest base is a delete and
    that have no operands are absent.  Operators that need no order fold stretches of sequences first and these by key;
    others take one shuffle on the key."""
    operand = F.when(F.col("op") == MERGE, F.col("value"))
    if merge.associative:
        parts = _fold(points.withColumn("stretch", F.floor(F.col("seq") / STRETCH)), merge, ["cf", "key", "stretch"], merge.operands(operand, F.col("seq")))
        # of the stretches since the newest base; only the oldest of these holds it
        since = F.max("base_seq").over(W.partitionBy("cf", "key"))
        used = parts.withColumn("since", since).filter(F.col("since").isNull() | (F.col("seq") >= F.col("since")))
        newest = F.max(F.when(F.col("base_seq") == F.col("since"), F.struct(F.col("base").alias("b"))))["b"]
        done = used.groupBy("cf", "key").agg(F.max("seq").alias("seq"), newest.alias("base"), F.sum("n").alias("n"), merge.combine(F.col("operands")).alias("operands"))
    else:
        done = _fold(points, merge, ["cf", "key"], merge.operands(operand, F.col("seq")))
    base = F.col("base")["value"]
    value = F.when(F.col("n") == 0, base).otherwise(F.coalesce(merge.full(base, F.col("operands")), base))
    return done.filter("n > 0 or base is not null").select("cf", "key", "seq", value.alias("value")).filter("value is not null")


def resolve(log: DataFrame, snapshot: int | None = None, merge: MergeOperator | None = None, has_ranges: bool = True, has_merges: bool | None = None) -> DataFrame:
    """(cf, key, seq, value) of every live key.  has_ranges, has_merges: from the manifest, so that a branch that is
    not needed is never planned."""
    seen = at_snapshot(log, snapshot)
    points = seen.filter(F.col("op") != RANGE_DELETE)
    tombs = tombstones.ranges(seen) if has_ranges else None
    if merge is None and has_merges:
        raise MergeOperatorNotConfigured
    if merge is not None and has_merges is not False:
        return folded(points if tombs is None else tombstones.uncovered_log(points, tombs), merge)
    # a head that is covered hides all older versions too, so only heads are tested
    unmerged = F.raise_error(F.lit("MergeOperatorNotConfigured: the newest record of a key is a merge")).cast("boolean")
    live = heads(points).filter(F.when(F.col("op") == MERGE, unmerged).otherwise(F.col("op") == PUT) if has_merges is None else F.col("op") == PUT)
    live = live if tombs is None else tombstones.uncovered(live, tombs)
    return live.select("cf", "key", "seq", "value")


def get(log: DataFrame, keys: list, snapshot: int | None = None, **how) -> DataFrame:
    """Point reads: the key filter stands below the aggregate; range deletes are filtered to those that may cover."""
    if not how.get("has_ranges", True):
        return resolve(log.filter(F.col("key").isin(keys)), snapshot, **how)
    low, high = min(keys), max(keys)
    near = (F.col("op") != RANGE_DELETE) & F.col("key").isin(keys) | (F.col("op") == RANGE_DELETE) & (F.col("key") <= high) & (F.col("end_key") > low)
    return resolve(log.filter(near), snapshot, **how)


def as_of(probe: DataFrame, log: DataFrame) -> DataFrame:
    """probe (cf, key, at, ...) with the newest PUT of the key at or before at, null if there is none.

    Probes and puts are sorted together and each probe takes the last put before it, so no probe is paired with a key's
    other versions."""
    puts = log.filter(F.col("op") == PUT).select("cf", "key", F.col("seq").alias("at"), F.struct("seq", "value").alias("put"), F.lit(0).alias("kind"))
    row = F.struct(*(F.col(f"`{c}`") for c in probe.columns))
    asked = probe.select("cf", "key", "at", row.alias("row"), F.lit(1).alias("kind"))
    both = puts.unionByName(asked, allowMissingColumns=True)
    last = F.last("put", ignorenulls=True).over(W.partitionBy("cf", "key").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("found", last).filter("kind = 1")
    return found.select(*(F.col(f"row.`{c}`") for c in probe.columns), F.col("found.seq").alias("found_seq"), F.col("found.value").alias("value"))


def latest_sequences(log: DataFrame) -> DataFrame:
    """Newest sequence of each key over all kinds of point records."""
    return log.filter(F.col("op") != RANGE_DELETE).groupBy("cf", "key").agg(F.max("seq").alias("seq"))


def conflicts(write_set: DataFrame, log: DataFrame, ranges_too: bool = False) -> DataFrame:
    """Rows of the write set (txn_id, begin_seq, cf, key) whose key has a newer record than their begin."""
    newer = (F.col("w.cf") == F.col("l.cf")) & (F.col("w.key") == F.col("l.key")) & (F.col("l.seq") > F.col("w.begin_seq"))
    points = latest_sequences(log)
    hit = write_set.alias("w").join(points.alias("l"), newer, "left_semi")
    if ranges_too:
        covered = tombstones.cover(write_set, tombstones.ranges(log)).filter(F.col("cover") > F.col("begin_seq")).drop("cover")
        hit = hit.unionByName(covered).distinct()
    return hit


def overlay(pending: DataFrame, base: DataFrame) -> DataFrame:
    """Reads of an open transaction: its last operation on a key hides the base; a merge shows its raw operand."""
    last = pending.groupBy("cf", "key").agg(F.max_by(F.struct("op", "value"), "ord").alias("p"))
    both = last.join(base.select("cf", "key", F.col("value").alias("old"), F.lit(True).alias("held")), ["cf", "key"], "full")
    value: Column = F.when(F.col("p").isNull(), F.col("old")).when(F.col("p.op").isin(PUT, MERGE), F.col("p.value"))
    live = F.when(F.col("p").isNull(), F.col("held")).otherwise(F.col("p.op").isin(PUT, MERGE))
    return both.filter(live).select("cf", "key", value.alias("value"))
