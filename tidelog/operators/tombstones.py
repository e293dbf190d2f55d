"""Range tombstones [begin, end) at a sequence number, as interval operators.

Tombstones are (cf, begin, end, tseq).  Keys are cut into buckets at a sample of the tombstones' ends; bounds that a caller
gives are kept and cut further by it.  A tombstone is cut into the pieces that it has in the buckets of its two ends; the
buckets between are covered as a whole, in runs of 2**level buckets.  A bucket's pieces become its steps, sorted and each with
its newest tombstone, in one row, so a key meets them by a join with namespace and bucket as its equalities, whatever the
sizes: Spark may broadcast the smaller side or shuffle both; the key then searches its step.  Any bounds give the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schema import RANGE_DELETE

#: Bounds of buckets are taken from so many sampled ends; of these every FINE-th cuts first.
SAMPLE, FINE = 4096, 64


def ranges(log: DataFrame) -> DataFrame:
    """(cf, begin, end, tseq) of a log's range deletes; degenerate ones delete nothing."""
    rows = log.filter((F.col("op") == RANGE_DELETE) & (F.col("key") < F.col("end_key")))
    return rows.select("cf", F.col("key").alias("begin"), F.col("end_key").alias("end"), F.col("seq").alias("tseq"))


def _sql(key) -> str:
    """A key as a literal of its type."""
    return f"CAST(X'{key.encode().hex()}' AS STRING)" if isinstance(key, str) else f"X'{bytes(key).hex()}'"


class Buckets:
    """Buckets of keys between sorted bounds: which one a key is in is how many bounds are not above it."""

    def __init__(self, bounds: list, source: DataFrame | None = None, exact: bool = False):
        #: source: the tombstones that were sampled; exact: all of their ends are bounds
        self.bounds, self.source, self.exact = bounds, source, exact
        self.coarse = bounds[FINE - 1 :: FINE]
        self.fine = [bounds[i * FINE : (i + 1) * FINE - 1] for i in range(len(self.coarse) + 1)]

    @classmethod
    def of(cls, tombs: DataFrame, sample: int = SAMPLE, given: Buckets | None = None) -> Buckets:
        """From the ends of least hash, sample of them at most: one stage that reads the tombstones only.  The hash is of the
        tombstone too, so that an end of very many does not crowd out the others.  Bounds given stay bounds; alone they may
        leave nearly all tombstones and keys in one bucket."""
        if given is not None and given.source is tombs:
            return given
        ends = tombs.select(F.explode(F.array("begin", "end")).alias("at"), "tseq")
        least = ends.orderBy(F.xxhash64("at", "tseq"), "at").limit(sample).select("at")
        rows = least.collect()
        own = () if given is None else given.bounds
        return cls(sorted({b if isinstance(b, str) else bytes(b) for b in (*own, *(r[0] for r in rows))}), tombs, len(rows) < sample)

    def at(self, name: str) -> Column:
        """The bucket of a key column: a search among the coarse bounds, then a count among the fine ones between two of them."""

        def search(low: int, high: int) -> str:
            if low == high:
                fine = [_sql(b) for b in self.fine[low]]
                if not fine:
                    return str(low * FINE)
                # the column must not stand inside the lambda only: the optimiser would take the bucket for a constant then
                return f"CASE WHEN `{name}` < {fine[0]} THEN {low * FINE} ELSE {low * FINE} + size(filter(array({', '.join(fine)}), b -> b <= `{name}`)) END"
            middle = (low + high) // 2
            return f"CASE WHEN `{name}` < {_sql(self.coarse[middle])} THEN {search(low, middle)} ELSE {search(middle + 1, high)} END"

        return F.expr(search(0, len(self.coarse))).cast("int")


def _cells(tombs: DataFrame, buckets: Buckets) -> DataFrame:
    """(cf, bucket, start, stop) between neighbouring ends; the last of a bucket ends where the next bucket with ends begins."""
    ends = tombs.select("cf", F.explode(F.array("begin", "end")).alias("start")).distinct().withColumn("bucket", buckets.at("start"))
    first = ends.groupBy("cf", "bucket").agg(F.min("start").alias("first"))
    after = first.select("cf", "bucket", F.lead("first").over(W.partitionBy("cf").orderBy("bucket")).alias("after"))
    inside = ends.withColumn("stop", F.lead("start").over(W.partitionBy("cf", "bucket").orderBy("start")))
    return inside.join(after, ["cf", "bucket"]).select("cf", "bucket", "start", F.coalesce("stop", "after").alias("stop")).filter("stop is not null")


def _spread(tombs: DataFrame, buckets: Buckets) -> tuple[DataFrame, DataFrame]:
    """Tombstones in the buckets of their ends, and (cf, low, high, tseq) of those over all of the buckets low to high."""
    marked = tombs.withColumn("low", buckets.at("begin")).withColumn("high", buckets.at("end"))
    ends = marked.withColumn("bucket", F.explode(F.array_distinct(F.array("low", "high")))).drop("low", "high")
    whole = marked.filter("high - low > 1").select("cf", (F.col("low") + 1).alias("low"), (F.col("high") - 1).alias("high"), "tseq")
    return ends, whole


def fragments(tombs: DataFrame, buckets: Buckets | None = None) -> DataFrame:
    """(cf, start, stop, seqs descending): disjoint intervals between neighbouring ends, with all that cover them."""
    buckets = Buckets.of(tombs, given=buckets)
    cells, (ends, whole) = _cells(tombs, buckets), _spread(tombs, buckets)
    inside = (F.col("t.begin") <= F.col("c.start")) & (F.col("t.end") >= F.col("c.stop")) & (F.col("c.cf") == F.col("t.cf")) & (F.col("c.bucket") == F.col("t.bucket"))
    near = cells.alias("c").join(ends.alias("t"), inside).select("c.cf", "c.start", "c.stop", "t.tseq")
    over = whole.withColumn("bucket", F.explode(F.sequence("low", "high"))).select("cf", "bucket", "tseq")
    far = cells.join(over, ["cf", "bucket"]).select("cf", "start", "stop", "tseq")
    return near.unionByName(far).groupBy("cf", "start", "stop").agg(F.sort_array(F.collect_set("tseq"), asc=False).alias("seqs"))


def _cells_covered(tombs: DataFrame, buckets: Buckets) -> DataFrame:
    """(cf, bucket, seq) of the newest tombstone where every end is a bound: tombstones cover whole buckets, from low to before
    high, and nothing is left to look at inside."""
    nothing = f"CAST(NULL AS {tombs.schema['begin'].dataType.simpleString()})"
    marked = tombs.select("cf", "tseq", (buckets.at("begin") - 1).alias("low"), buckets.at("end").alias("high"))
    spread = marked.selectExpr("cf", "tseq", f"inline(array_compact(array({', '.join(_whole(buckets, nothing))})))")
    best = spread.groupBy("cf", "level", "node").agg(F.max("tseq").alias("tseq"))
    return _dealt(best, "cf", "tseq").groupBy("cf", "bucket").agg(F.max("tseq").alias("seq"))


def _dealt(best: DataFrame, *names: str, into: str = "bucket") -> DataFrame:
    """Nodes as one row for each bucket, or end, that they cover."""
    return best.selectExpr(*names, f"explode(sequence(shiftleft(1, level) * node, shiftleft(1, level) * (node + 1) - 1)) AS {into}")


def _whole(buckets: Buckets, begin: str) -> list[str]:
    """The buckets strictly between low and high as (level, node), node covering the 2**level buckets from node * 2**level on:
    two of a level at most, and null where there is none, so that a wide tombstone is some twenty rows and not all its buckets."""
    out = []
    for level in range(len(buckets.bounds).bit_length()):
        # of [low + 1, high), the first and the last node that lie inside
        first, end = f"shiftright(low + {1 << level}, {level})", f"shiftright(high, {level})"
        for node, odd in ((first, first), (f"{end} - 1", end)):
            out.append(f"IF({first} < {end} AND {odd} & 1 = 1, {_place(level, node, begin, begin)}, NULL)")
    return out


def _place(level: int, node: str, begin: str, end: str) -> str:
    return f"named_struct('level', {level}, 'node', {node}, 'begin', {begin}, 'end', {end})"


def _nodes(low: str, high: str) -> str:
    """Of [low, high), the nodes (as in _whole) that make it up: two of a level at most, and no level that is wider than it."""
    first, end = f"shiftright({low} + shiftleft(1, l) - 1, l)", f"shiftright({high}, l)"
    node = lambda at, odd: f"IF({first} < {end} AND {odd} & 1 = 1, named_struct('level', l, 'node', {at}), NULL)"
    return f"array_compact(flatten(transform(sequence(0, length(bin({high} - {low})) - 1), l -> array({node(first, first)}, {node(end + ' - 1', end)}))))"


def pieces(tombs: DataFrame, buckets: Buckets) -> DataFrame:
    """(cf, bucket, begin, end, tseq): the newest tombstone over each stretch of a bucket that one covers; nulls are open ends.
    The tombstones are read once.  Expressions are SQL text, as so many of them would take longer to build one by one than to run."""
    nothing = f"CAST(NULL AS {tombs.schema['begin'].dataType.simpleString()})"
    ends = [_place(0, "low", "`begin`", f"IF(low = high, `end`, {nothing})"), f"IF(low < high, {_place(0, 'high', nothing, '`end`')}, NULL)"]
    marked = tombs.select("cf", "begin", "end", "tseq", buckets.at("begin").alias("low"), buckets.at("end").alias("high"))
    spread = marked.selectExpr("cf", "tseq", f"inline(array_compact(array({', '.join(ends + _whole(buckets, nothing))})))")
    best = spread.groupBy("cf", "level", "node", "begin", "end").agg(F.max("tseq").alias("tseq"))
    return _dealt(best, "cf", "begin", "end", "tseq")


def steps(tombs: DataFrame, buckets: Buckets) -> DataFrame:
    """(cf, bucket, jumps, steps): where a bucket's newest tombstone changes, as (at, seq) sorted by at; a first at of null is
    the bucket's begin, a seq of null means none.  jumps are the powers of two that a search among the steps takes.

    The ends are numbered in their order, and each piece is dealt to the runs of 2**level ends that make it up, so that a
    bucket of n pieces takes n log n rows, none for a pair of pieces.  After the pieces one shuffle on cf and bucket is enough."""
    ordered = W.partitionBy("cf", "bucket")
    ends = pieces(tombs, buckets).selectExpr("*", "explode(array_compact(array(named_struct('at', `begin`, 'last', false), IF(`end` IS NULL, NULL, named_struct('at', `end`, 'last', true))))) AS x")
    ranked = ends.select("cf", "bucket", "begin", "end", "tseq", "x.last", F.dense_rank().over(ordered.orderBy("x.at")).alias("rank")).withColumn("top", F.max("rank").over(ordered))
    # a piece lies between the numbers of its ends; an open end is above all of them
    spans = ranked.groupBy("cf", "bucket", "begin", "end").agg(F.expr("max(tseq) AS tseq"), F.expr("min(rank) AS low"), F.expr("max(IF(last, rank, IF(`end` IS NULL, top + 1, 0))) AS high"))
    no_at, no_seq = (f"CAST(NULL AS {tombs.schema[x].dataType.simpleString()})" for x in ("begin", "tseq"))
    row = lambda level, node, at, seq: f"named_struct('level', {level}, 'node', {node}, 'at', {at}, 'seq', {seq})"
    marks = f"array({row(0, 'low', '`begin`', no_seq)}, IF(`end` IS NULL, NULL, {row(0, 'high', '`end`', no_seq)}))"
    runs = f"transform({_nodes('low', 'high')}, x -> {row('x.level', 'x.node', no_at, 'tseq')})"
    dealt = spans.selectExpr("cf", "bucket", f"inline(array_compact(concat({marks}, {runs})))")
    best = dealt.groupBy("cf", "bucket", "level", "node").agg(F.max("seq").alias("seq"), F.max("at").alias("at"))
    each = _dealt(best, "cf", "bucket", "seq", "at", into="rank")
    stairs = each.groupBy("cf", "bucket", "rank").agg(F.max("at").alias("at"), F.max("seq").alias("seq"))
    rows = stairs.groupBy("cf", "bucket").agg(F.sort_array(F.collect_list(F.struct("at", "seq"))).alias("steps"))
    return rows.selectExpr("cf", "bucket", "transform(sequence(length(bin(size(steps))) - 1, 0, -1), l -> shiftleft(1, l)) AS jumps", "steps")


def cover(points: DataFrame, tombs: DataFrame, buckets: Buckets | None = None) -> DataFrame:
    """points with cover: the highest tseq over the key, null if none."""
    buckets = Buckets.of(tombs, given=buckets)
    if not buckets.bounds:
        return points.withColumn("cover", F.lit(None).cast(tombs.schema["tseq"].dataType))
    names = [F.col(f"p.`{x}`") for x in points.columns]
    dealt = points.withColumn("bucket", buckets.at("key"))
    held = _cells_covered(tombs, buckets) if buckets.exact else steps(tombs, buckets)
    met = dealt.alias("p").join(held.alias("c"), (F.col("p.cf") == F.col("c.cf")) & (F.col("p.bucket") == F.col("c.bucket")), "left")
    if buckets.exact:
        return met.select(*names, F.col("c.seq").alias("cover"))
    # the last step that begins at or before the key
    found = "aggregate(c.jumps, 0, (i, jump) -> IF(i + jump <= size(c.steps) AND coalesce(get(c.steps, i + jump - 1).at <= p.key, true), i + jump, i))"
    return met.select(*names, F.expr(f"get(c.steps, {found} - 1).seq").alias("cover"))


def uncovered(points: DataFrame, tombs: DataFrame, buckets: Buckets | None = None) -> DataFrame:
    """The rows that no newer tombstone hides.  Keys may repeat: a log of many versions has its keys covered first."""
    return cover(points, tombs, buckets).filter(F.col("cover").isNull() | (F.col("seq") >= F.col("cover"))).drop("cover")


def uncovered_log(points: DataFrame, tombs: DataFrame, buckets: Buckets | None = None) -> DataFrame:
    """As uncovered, for many versions of each key: each key is covered once, and the versions are shuffled on (cf, key) only,
    as what follows needs them."""
    keys = cover(points.select("cf", "key").distinct(), tombs, buckets).filter("cover is not null")
    met = points.join(keys, ["cf", "key"], "left")
    return met.filter(F.col("cover").isNull() | (F.col("seq") >= F.col("cover"))).select(points.columns)
