"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

Targets: a share of all words dealt to sources by weight, a source's target stopping at a multiple of
its size and the excess going to the others by weight until none is above.  Equal blocks of words are
then apportioned to sources by highest quotients (target / 1, 3, 5, ...), the same way from a source to
groups of FAN shards and from these to the shards (documents dealt by a seeded hash; as many as the source's
words ask for), and inside a shard the quota is taken as whole passes
plus a seeded, evenly spaced choice of blocks over a seeded order.  Every step is closed arithmetic on
aggregates, so no block is ever a row.

Cases: null text has size 0; null source is a source of its own, last; null ids are dealt by their texts; an
empty table gives no rows; repeated rows are separate rows with equal results only in size, as each takes its
own place in the order; ties in the seeded order fall to doc_id, size and then the text's hash; a very long
text fills a shard and counts whole; further input columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, text_or_empty

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 16
SHARD_WORDS = 250_000
#: Shards of a source that share a quota of their own, so that no window holds all shards of a source.
FAN = 1024
#: So many sources are sent to every task, in place of a shuffle of all rows.
FEW_SOURCES = 50_000
#: Of more sources, copies of each source's row, so that a source with a third of all documents is joined in many tasks.
SALTS = 64
SEED = "mix-1"


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def _hash32(*parts: Column) -> Column:
    """32 bits of MD5, which every SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, share_percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size) to these and (weight, target): filling up to a common level of words a unit of weight."""
    names = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(names) - 1) % len(WEIGHTS)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * most
    by_fill = W.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(everything) * share_percent - 100 * F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighed.withColumn("level", left.cast("double") / (weight_left * 100)).withColumn("full", F.col("level") * F.col("weight") >= cap)
    level = F.min(F.when(~F.col("full"), F.struct((cap / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)["level"]
    return levelled.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(level * F.col("weight"))).select("source", "source_size", "weight", "target")


def apportion(df: DataFrame, within: list[str], share: str, seats: Column, order: list[Column]) -> DataFrame:
    """Adds quota: Sainte-Laguë seats of each row among the rows with equal values in within.

    A row's fair share bounds its seats from both sides (the common divisor moves by at most half a seat
    a rival), so only the quotients inside that band are ranked.
    """
    group = W.partitionBy(*within) if within else W.partitionBy()
    base = (
        df.withColumn("_seats", seats)
        .withColumn("_all", F.sum(share).over(group))
        .withColumn("_rivals", F.count(F.lit(1)).over(group))
        .withColumn("_part", F.when(F.col("_all") > 0, F.col(share) / F.col("_all")).otherwise(0.0))
        .withColumn("_fair", F.col("_part") * F.col("_seats"))
        .withColumn("_band", F.ceil(F.col("_part") * F.col("_rivals") / 2) + 2)
        .withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_fair")) - F.col("_band")))
        .withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    )
    picks = base.withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.floor(F.col("_fair")) + F.col("_band") + 1)))
    best = (W.partitionBy(*within) if within else W.partitionBy()).orderBy((F.col(share) / (2 * F.col("_k") - 1)).desc(), *order, F.col("_k"))
    won = (F.row_number().over(best) <= F.col("_open")) & (F.col(share) > 0)
    keys = [c for c in df.columns]
    return picks.withColumn("_won", won).groupBy(*keys, "_sure").agg(F.sum(F.col("_won").cast("long")).alias("_more")).withColumn("quota", F.col("_sure") + F.col("_more")).drop("_sure", "_more")


def _named(name: str = "doc_id") -> Column:
    """What a row's hashes are made of: its doc_id, or for a null one its text, so that null ids do not meet."""
    return F.coalesce(F.col(name).cast("string"), F.concat(F.lit("t"), F.md5(text_or_empty())))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), _named().alias("name"), F.xxhash64("text").alias("tie"), *more)


def _source_id() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))


def plan(sizes: DataFrame, share_percent: int = 150, most: int = 2, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(_id, shards, source_size, target) of the sources and (_id, shard, n, passes, rest, turn) of their shards."""
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), share_percent, most)
    blocks = F.ceil(F.sum("target").over(W.partitionBy()) / block)
    sources = apportion(sources, [], "target", blocks, [F.col("source").asc_nulls_last()]).withColumnRenamed("quota", "source_quota")
    sources = cut(sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).withColumn("_id", _source_id()).drop("source"))
    shards = cut(_dealt(sizes, sources).groupBy("_id", "shard").agg(F.sum("size").alias("shard_size")).withColumn("group", F.floor(F.col("shard") / fan)))
    groups = shards.groupBy("_id", "group").agg(F.sum("shard_size").alias("group_size")).join(sources.select("_id", "source_quota"), "_id")
    groups = apportion(groups, ["_id"], "group_size", F.col("source_quota"), [F.col("group")]).select("_id", "group", F.col("quota").alias("group_quota"))
    shards = apportion(shards.join(groups, ["_id", "group"]), ["_id", "group"], "shard_size", F.col("group_quota"), [F.col("shard")])
    n = F.ceil(F.col("shard_size") / block)
    shards = (
        shards.withColumn("n", n)
        .withColumn("quota", F.least(F.col("quota"), F.col("n") * most))
        .withColumn("passes", F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("n"))
        .withColumn("turn", F.when(F.col("n") > 0, _hash32(F.lit("turn"), F.col("_id"), F.col("shard").cast("string")) % F.col("n")).otherwise(0))
        .select("_id", "shard", "n", "passes", "rest", "turn")
    )
    return sources, shards


def _dealt(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's facts and their shard."""
    keyed = sizes.withColumn("_id", _source_id()).withColumn("key", _hash32(F.lit("doc"), F.col("name"))).withColumn("_salt", F.col("key") % SALTS).drop("source")
    facts = ["_id", "shards", "source_size", "target"]
    if sources.count() <= FEW_SOURCES:  # a row of it is some tens of bytes
        return keyed.join(F.broadcast(sources.select(facts)), "_id").withColumn("shard", F.col("key") % F.col("shards")).drop("_salt")
    salted = sources.select("_id", "shards", "source_size", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return keyed.join(salted, ["_id", "_salt"]).withColumn("shard", F.col("key") % F.col("shards")).drop("_salt")


def _placed(sizes: DataFrame, sources: DataFrame, shards: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The rows with taken: their words in the chosen blocks of their shard's seeded order."""
    order = W.partitionBy("_id", "shard").orderBy("spot", F.col("doc_id").asc_nulls_last(), "size", "tie")
    placed = (
        _dealt(sizes, sources)
        .withColumn("spot", _hash32(F.lit("spot"), F.col("name")))
        .withColumn("stop", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("from", F.col("stop") - F.col("size"))
        .join(shards, ["_id", "shard"])
    )

    def before(at: Column) -> Column:
        """Words of chosen blocks among the first words of the shard."""
        b = F.floor(at / block)
        chosen = lambda j: F.floor((j * F.col("rest") + F.col("turn")) / F.col("n"))
        return chosen(b) * block + (at - b * block) * (chosen(b + 1) - chosen(b))

    taken = F.when(F.col("n") > 0, F.col("passes") * F.col("size") + before(F.col("stop")) - before(F.col("from"))).otherwise(0)
    return placed.withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, share_percent: int = 150, most: int = 2, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, fan: int = FAN) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words of each document that the mix takes, repeats counted."""
    sizes = cut(_sized(docs))
    placed = _placed(sizes, *plan(sizes, share_percent, most, block, shard_words, fan), block)
    return placed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def remixed(docs: DataFrame, share_percent: int = 150, most: int = 2, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, fan: int = FAN) -> DataFrame:
    """The documents, all columns whatever their names, each row as often as the mix takes it: taken / size times, the
    fraction rounded by a seeded hash, so that a source's words come near its target.

    Null ids, repeated rows and ties are placed as rows of their own; rows without words are taken never; texts of any
    length travel once, with their row; no rows, no mix."""
    plans = plan(cut(_sized(docs)), share_percent, most, block, shard_words, fan)
    names = docs.columns
    placed = _placed(_sized(docs, F.struct(*(F.col(f"`{x}`") for x in names)).alias("row")), *plans, block)
    part = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    times = F.floor(part + _hash32(F.lit("round"), F.col("name")) / F.lit(2.0**32)).cast("int")
    copies = placed.select("row", times.alias("times")).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*(F.col(f"row.`{x}`") for x in names))
