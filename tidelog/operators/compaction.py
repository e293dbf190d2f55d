"""Compaction as a rewrite of the log, and the pickers that choose its input.

s_min is the oldest pinned snapshot (the newest sequence if none is pinned): reads at s_min and later are unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schema import DELETE, MERGE, PUT, RANGE_DELETE, SINGLE_DELETE
from . import tombstones
from .filters import CompactionFilter
from .merge import MergeOperator

_ENDS = (PUT, DELETE, SINGLE_DELETE)


def drop_shadowed(points: DataFrame, s_min: int) -> DataFrame:
    """Without versions that have a newer one at or before s_min."""
    newer = F.lag("seq").over(W.partitionBy("cf", "key").orderBy(F.col("seq").desc()))
    return points.withColumn("newer", newer).filter(F.col("newer").isNull() | (F.col("newer") > s_min)).drop("newer")


def _held(keys: DataFrame, files: DataFrame) -> DataFrame:
    """keys with cover: not null where the range of a file (cf, smallest, largest) holds the key."""
    after = F.concat(F.col("largest"), F.lit(b"\0") if str(files.schema["largest"].dataType) == "BinaryType()" else F.lit("\0"))
    return tombstones.cover(keys, files.select("cf", F.col("smallest").alias("begin"), after.alias("end"), F.lit(1).alias("tseq")))


def drop_tombstones(points: DataFrame, s_min: int, deeper: DataFrame | None = None) -> DataFrame:
    """Without deletes at or before s_min whose key no deeper file may hold (deeper: cf, smallest, largest)."""
    dead = F.col("op").isin(DELETE, SINGLE_DELETE) & (F.col("seq") <= s_min)
    if deeper is None:
        return points.filter(~dead)
    return _held(points, deeper).filter(~dead | F.col("cover").isNotNull()).drop("cover")


def collapse(points: DataFrame, s_min: int, merge: MergeOperator, bottom: bool = True) -> DataFrame:
    """Of keys with merges, folds the operands at or before s_min: onto their base, or at the bottom onto nothing, into one
    PUT; else, if the operator can, into one operand.  Rows above s_min keep their own sequences.  Of other keys, versions that
    have a newer one at or before s_min go.  merged marks rows of keys with merges.

    All flags are windows on the key, and the folding an aggregate on it, so the log is read and shuffled once."""
    key, low = W.partitionBy("cf", "key"), F.col("seq") <= s_min
    marked = (
        points.withColumn("merged", F.max((F.col("op") == MERGE).cast("int")).over(key) == 1)
        .withColumn("base_seq", F.max(F.when(low & F.col("op").isin(*_ENDS), F.col("seq"))).over(key))
        .withColumn("newest", F.max(F.when(low, F.struct("seq", "op"))).over(key))
        .withColumn("newer", F.lag("seq").over(key.orderBy(F.col("seq").desc())))
    )
    shadowed = ~F.col("merged") & F.col("newer").isNotNull() & (F.col("newer") <= s_min)
    below = F.col("merged") & low & F.col("base_seq").isNotNull() & (F.col("seq") < F.col("base_seq"))
    foldable = F.lit(True) if bottom or merge.associative else F.col("base_seq").isNotNull()
    run = F.col("merged") & low & (F.col("newest.op") == MERGE) & foldable
    # the rows of a run are one group, every other row is its own
    dealt = marked.filter(~shadowed & ~below).withColumn("run", run).withColumn("group", F.when(F.col("run"), F.lit(-1)).otherwise(F.col("seq")))
    operand = F.when(F.col("run") & (F.col("op") == MERGE), F.col("value"))
    done = dealt.groupBy("cf", "key", "group").agg(
        F.max("seq").alias("seq"),
        F.max("op").alias("op"),
        F.max(F.struct("value")).alias("own"),
        F.max("run").alias("run"),
        F.max("merged").alias("merged"),
        F.max(F.when(F.col("op") == PUT, F.struct("value"))).alias("base"),
        F.max("base_seq").alias("base_seq"),
        merge.operands(operand, F.col("seq")).alias("operands"),
    )
    whole = F.lit(True) if bottom else F.col("base_seq").isNotNull()
    base = F.col("base")["value"]
    value = F.when(whole, F.coalesce(merge.full(base, F.col("operands")), base)).otherwise(merge.partial(F.col("operands"))).cast(points.schema["value"].dataType)
    op = F.when(F.col("run"), F.when(whole, F.lit(PUT)).otherwise(F.lit(MERGE))).otherwise(F.col("op"))
    return done.select("cf", "key", "seq", op.alias("op"), F.when(F.col("run"), value).otherwise(F.col("own")["value"]).alias("value"), "merged")


def apply_filter(points: DataFrame, how: CompactionFilter, level: int, s_min: int | None, where: Column | None = None) -> DataFrame:
    """The filter on the newest PUT of each key, unless a live snapshot (s_min) still sees it; where: on these rows only."""
    first = F.row_number().over(W.partitionBy("cf", "key").orderBy(F.col("seq").desc())) == 1
    due = first & (F.col("op") == PUT) & (F.lit(True) if where is None else where)
    due = due if s_min is None else due & (F.col("seq") > s_min)
    marked = points.withColumn("due", due)
    kept = marked.filter(~(F.col("due") & how.remove(level, F.col("key"), F.col("value"))))
    return kept.withColumn("value", F.when(F.col("due"), how.change(level, F.col("key"), F.col("value"))).otherwise(F.col("value"))).drop("due")


def rewrite(
    log: DataFrame,
    s_min: int,
    merge: MergeOperator | None = None,
    how: CompactionFilter | None = None,
    live_snapshot: bool = False,
    level: int = 1,
    bottom: bool = True,
    keep_tombstones: bool = False,
    deeper: DataFrame | None = None,
    has_ranges: bool = True,
) -> DataFrame:
    """The log with everything dropped that no read at or after s_min needs.  has_ranges: from the manifest; without, no branch
    for range deletes is planned.

    Filters see each value once a call; values that merges derive are filtered at the bottom only."""
    columns = ["cf", "key", "seq", "op", "value", "end_key"]
    points, ranges = log.filter(F.col("op") != RANGE_DELETE).drop("end_key"), log.filter(F.col("op") == RANGE_DELETE)
    if has_ranges:
        points = tombstones.uncovered_log(points, tombstones.ranges(ranges.filter(F.col("seq") <= s_min)))
    if how is not None and merge is not None:
        open_ = F.col("op") == MERGE if not live_snapshot else (F.col("op") == MERGE) & (F.col("seq") > s_min)
        points = points.filter(~open_ | how.keep_operand(level, F.col("key"), F.col("value")))
    if merge is None:
        points = drop_shadowed(points, s_min)
        points = points if how is None else apply_filter(points, how, level, s_min if live_snapshot else None)
    else:
        points = collapse(points, s_min, merge, bottom)
        if how is not None:
            points = apply_filter(points, how, level, s_min if live_snapshot else None, None if bottom else ~F.col("merged"))
        points = points.drop("merged")
    if bottom and not keep_tombstones:
        points = drop_tombstones(points, s_min)
        ranges = ranges.filter(F.col("seq") > s_min)
    elif deeper is not None and not keep_tombstones:
        points = drop_tombstones(points, s_min, deeper)
    points = points.withColumn("end_key", F.lit(None).cast(log.schema["end_key"].dataType)).select(columns)
    return points.unionByName(ranges.select(columns)) if has_ranges else points


def partial_merges(log: DataFrame, merge: MergeOperator, by: str = "file_no") -> DataFrame:
    """Each file's operands of a key combined into one, for operators that may combine without a base."""
    operands = log.filter(F.col("op") == MERGE)
    made = operands.groupBy("cf", "key", by).agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"), merge.partial(merge.operands(F.col("value"), F.col("seq"))).alias("value"))
    return made


# Pickers.  files: (cf, level, file_no, size, smallest, largest, min_seq, max_seq)


def level_scores(files: DataFrame, trigger: int = 4, base_bytes: int = 10 << 20) -> DataFrame:
    """Files, bytes and score of each level: level 0 by its file count, others by bytes over ten to the level."""
    sums = files.groupBy("cf", "level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    limit = F.lit(float(base_bytes)) * F.pow(F.lit(10.0), F.greatest(F.col("level") - 1, F.lit(0)))
    return sums.withColumn("score", F.when(F.col("level") == 0, F.col("files") / F.lit(float(trigger))).otherwise(F.col("bytes") / limit))


def pick_level(scores: DataFrame, last: int = 6) -> DataFrame:
    """The level to compact of each namespace: the highest score of at least 1, the last level never."""
    due = scores.filter((F.col("score") >= 1) & (F.col("level") < last))
    return due.groupBy("cf").agg(F.max_by("level", F.struct("score", -F.col("level"))).alias("level"), F.max("score").alias("score"))


def overlaps(files: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of files whose key ranges meet."""
    on = (F.col("a.cf") == F.col("b.cf")) & (F.col("a.smallest") <= F.col("b.largest")) & (F.col("a.largest") >= F.col("b.smallest"))
    return files.alias("a").join(others.alias("b"), on).select(F.col("a.cf").alias("cf"), F.col("a.file_no").alias("file_no"), F.col("b.file_no").alias("other_no"))


def base_level_keys(keys: DataFrame, deeper: DataFrame) -> DataFrame:
    """Keys that no deeper file's range holds."""
    return _held(keys, deeper).filter("cover is null").drop("cover")


def fifo_evict(files: DataFrame, budget: int) -> DataFrame:
    """Oldest files to drop so that what is left fits the budget; the newest always stays."""
    newest = W.partitionBy("cf").orderBy(F.col("file_no").desc())
    held = files.withColumn("held", F.sum("size").over(newest.rowsBetween(W.unboundedPreceding, 0))).withColumn("age", F.row_number().over(newest))
    return held.filter((F.col("held") > budget) & (F.col("age") > 1)).drop("held", "age")


def universal_pick(files: DataFrame, size_ratio: int = 1, min_width: int = 2, max_amplification: int = 200) -> DataFrame:
    """The newest sorted runs to merge: all, if those newer than the oldest exceed max_amplification percent of it;
    else the longest row of newest runs each at most size_ratio percent above what precedes it, if wide enough."""
    newest = W.partitionBy("cf").orderBy(F.col("file_no").desc())
    run = files.withColumn("at", F.row_number().over(newest)).withColumn("before", F.sum("size").over(newest.rowsBetween(W.unboundedPreceding, -1)))
    all_ = W.partitionBy("cf")
    run = run.withColumn("runs", F.count(F.lit(1)).over(all_)).withColumn("oldest", F.max_by("size", -F.col("file_no")).over(all_)).withColumn("total", F.sum("size").over(all_))
    amplified = ((F.col("total") - F.col("oldest")) * 100 > F.col("oldest") * max_amplification) & (F.col("runs") >= min_width)
    breaks = F.when(F.col("before").isNotNull() & (F.col("size") * 100 > F.col("before") * (100 + size_ratio)), F.col("at"))
    run = run.withColumn("amplified", amplified).withColumn("stop", F.coalesce(F.min(breaks).over(all_), F.col("runs") + 1))
    row = (F.col("at") < F.col("stop")) & (F.col("stop") - 1 >= min_width)
    return run.filter(F.col("amplified") | row).select(*files.columns, F.when(F.col("amplified"), F.lit("space")).otherwise(F.lit("ratio")).alias("reason"))
