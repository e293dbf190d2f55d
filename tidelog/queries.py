"""Queries of the key-value engine over the shared tables, with their SQL.

Logs derived from events (seq = event_id + 1, key = user%06d, v = cents):
w, counters: signup puts, error deletes, the rest merges.  p, plain: error deletes (users not divisible by 10), the
rest puts props; errors of users divisible by 10 are range deletes [user, user + 5).  c: the event type is the
namespace.  Segments are 1000 sequences long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .operators import compaction, merge, scan, stats, tombstones, visibility
from .operators.filters import AppendSuffix, Context, RemoveByValuePrefix, RemoveOperandByValue, prefix_drop_factory
from .schema import MERGE, PUT

S_BIG, S_SMALL, PINNED = 6000, 300, 5000


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.format_string("user%06d", "user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), "event_type", "user_id", "props", F.round(F.col("value") * 100).cast("long").alias("v"))


def _log(df: DataFrame, op: Column, value: Column, cf: Column | None = None, end: Column | None = None) -> DataFrame:
    return df.select((F.lit("default") if cf is None else cf).alias("cf"), "key", "seq", op.alias("op"), value.alias("value"), (F.lit(None).cast("string") if end is None else end).alias("end_key"))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "PUT").when(F.col("event_type") == "error", "DELETE").otherwise("MERGE")
    return _log(events(spark, sf), op, F.when(F.col("event_type") != "error", F.col("v")))


def plain(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    error, tens = F.col("event_type") == "error", F.col("user_id") % 10 == 0
    op = F.when(error & tens, "RANGE_DELETE").when(error, "DELETE").otherwise("PUT")
    return _log(e, op, F.when(~error, F.col("props")), end=F.when(error & tens, F.format_string("user%06d", F.col("user_id") + 5)))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return plain(spark, sf).filter("op <> 'RANGE_DELETE'")


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Counters, and the range deletes of p in place of those users' deletes."""
    e = events(spark, sf)
    error, tens = F.col("event_type") == "error", F.col("user_id") % 10 == 0
    op = F.when(error & tens, "RANGE_DELETE").when(error, "DELETE").when(F.col("event_type") == "signup", "PUT").otherwise("MERGE")
    return _log(e, op, F.when(~error, F.col("v")), end=F.when(error & tens, F.format_string("user%06d", F.col("user_id") + 5)))


def families(spark: SparkSession, sf: str) -> DataFrame:
    return _log(events(spark, sf), F.lit("PUT"), F.col("props"), cf=F.col("event_type"))


def segmented(df: DataFrame) -> DataFrame:
    return df.withColumn("file_no", F.floor((F.col("seq") - 1) / 1000).cast("long"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as files: every third of level 1, the rest of level 0; 64 bytes an entry."""
    f = segmented(points(spark, sf)).groupBy("cf", "file_no").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), (F.count(F.lit(1)) * 64).alias("size"))
    return f.withColumn("level", F.when(F.col("file_no") % 3 == 0, 1).otherwise(0))


KV = ("key", "value")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

W_SQL = "w AS (SELECT printf('user%06d', user_id) AS key, event_id + 1 AS seq, user_id, CASE event_type WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'MERGE' END AS op, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS v FROM events)"
A_SQL = "a AS (SELECT printf('user%06d', user_id) AS key, event_id + 1 AS seq, user_id, event_type, CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN 'RANGE_DELETE' WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CASE WHEN event_type <> 'error' THEN props END AS value FROM events)"
P_SQL = A_SQL + ", p AS (SELECT key, seq, op, value, user_id, CAST(floor((seq - 1) / 1000.0) AS BIGINT) AS file_no FROM a WHERE op <> 'RANGE_DELETE')"
R_SQL = P_SQL + ", r AS (SELECT key AS b, printf('user%06d', user_id + 5) AS e, seq AS tseq FROM a WHERE op = 'RANGE_DELETE')"
F_SQL = P_SQL + ", f AS (SELECT file_no, min(key) AS smallest, max(key) AS largest, min(seq) AS min_seq, max(seq) AS max_seq, count(*) * 64 AS size, CASE WHEN file_no % 3 = 0 THEN 1 ELSE 0 END AS level FROM p GROUP BY file_no)"
M_SQL = "m AS (SELECT printf('user%06d', user_id) AS key, event_id + 1 AS seq, user_id, CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN 'RANGE_DELETE' WHEN event_type = 'error' THEN 'DELETE' WHEN event_type = 'signup' THEN 'PUT' ELSE 'MERGE' END AS op, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS v FROM events), r AS (SELECT key AS b, printf('user%06d', user_id + 5) AS e, seq AS tseq FROM m WHERE op = 'RANGE_DELETE')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def latest(where: str = "TRUE", after: str = "TRUE", with_: str = P_SQL, source: str = "p") -> str:
    return f"WITH {with_}, h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {source} WHERE {where}) SELECT key, value FROM h WHERE rn = 1 AND op = 'PUT' AND {after}"


def counted(where: str = "TRUE", value: str = "CAST(sum(CASE WHEN op <> 'DELETE' THEN v END) AS BIGINT)") -> str:
    return f"WITH {W_SQL}, x AS (SELECT * FROM w WHERE {where}), b AS (SELECT key, max(CASE WHEN op IN ('PUT', 'DELETE') THEN seq END) AS bseq FROM x GROUP BY key) SELECT x.key, {value} AS value FROM x JOIN b USING (key) WHERE bseq IS NULL OR x.seq >= bseq GROUP BY x.key HAVING sum(CASE WHEN op <> 'DELETE' THEN v END) IS NOT NULL"


# Latest versions, snapshots, point reads

query("kv_latest", latest())(lambda s, d: visibility.resolve(points(s, d), has_ranges=False).select(*KV))
query("kv_scan_ordered", latest() + " ORDER BY key")(lambda s, d: scan.ordered(visibility.resolve(points(s, d), has_ranges=False)).select(*KV))
query("kv_delete_hides", f"WITH {P_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM p) SELECT key, seq FROM h WHERE rn = 1 AND op = 'DELETE'")(lambda s, d: visibility.heads(points(s, d)).filter("op = 'DELETE'").select("key", "seq"))
GET = ["user000001", "user000003", "user000007", "user000042", "user999999"]
query("kv_get_keys", latest("key IN (" + ", ".join(f"'{k}'" for k in GET) + ")"))(lambda s, d: visibility.get(points(s, d), GET, has_ranges=False).select(*KV))
query("kv_get_covered", f"WITH {R_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM p WHERE key IN ('user000010', 'user000012', 'user000020')) SELECT key, value FROM h WHERE rn = 1 AND op = 'PUT' AND NOT EXISTS (SELECT 1 FROM r WHERE h.key >= b AND h.key < e AND h.seq < tseq)")(lambda s, d: visibility.get(plain(s, d), ["user000010", "user000012", "user000020"]).select(*KV))
for _name, _s in (("kv_snapshot", S_BIG), ("kv_snapshot_small", S_SMALL)):
    query(_name, latest(f"seq <= {_s}"))(lambda s, d, at=_s: visibility.resolve(points(s, d), at, has_ranges=False).select(*KV))


@query("kv_asof_probe", f"WITH {P_SQL} SELECT q.key, q.seq AS at, max(l.seq) AS found_seq, arg_max(l.value, l.seq) AS value FROM p q LEFT JOIN p l ON l.key = q.key AND l.op = 'PUT' AND l.seq <= q.seq WHERE q.op = 'DELETE' GROUP BY ALL")
def _asof(s, d):
    p = points(s, d)
    return visibility.as_of(p.filter("op = 'DELETE'").select("cf", "key", F.col("seq").alias("at")), p).select("key", "at", "found_seq", "value")


query("kv_latest_sequence", f"WITH {P_SQL} SELECT key, max(seq) AS seq FROM p GROUP BY key")(lambda s, d: visibility.latest_sequences(plain(s, d)).select("key", "seq"))
query("kv_last_sequence", "SELECT max(event_id) + 1 AS last_seq, count(*) AS records FROM events")(lambda s, d: plain(s, d).agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("records")))

# Range deletes

RANGED = "WITH {r}, h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM p WHERE seq <= {s}) SELECT key, value FROM h WHERE rn = 1 AND op = 'PUT' AND NOT EXISTS (SELECT 1 FROM r WHERE h.key >= b AND h.key < e AND h.seq < tseq AND tseq <= {s})"
query("kv_delete_range", RANGED.format(r=R_SQL, s=1 << 50))(lambda s, d: visibility.resolve(plain(s, d)).select(*KV))
query("kv_delete_range_snapshot", RANGED.format(r=R_SQL, s=S_BIG))(lambda s, d: visibility.resolve(plain(s, d), S_BIG).select(*KV))
COVER = f"WITH {R_SQL}, k AS (SELECT DISTINCT key FROM p) SELECT key, max(tseq) AS cover FROM k JOIN r ON key >= b AND key < e GROUP BY key"
query("kv_range_max_cover", COVER)(lambda s, d: tombstones.cover(points(s, d).select("cf", "key").distinct(), tombstones.ranges(plain(s, d))).filter("cover is not null").select("key", "cover"))
query("kv_range_cover_bucketed", COVER)(lambda s, d: tombstones.cover(points(s, d).select("cf", "key").distinct(), tombstones.ranges(plain(s, d)), tombstones.Buckets(["user000002", "user000011", "user000040"])).filter("cover is not null").select("key", "cover"))
query("kv_tombstone_fragments", f"WITH {R_SQL}, ends AS (SELECT b AS start FROM r UNION SELECT e FROM r), c AS (SELECT start, lead(start) OVER (ORDER BY start) AS stop FROM ends) SELECT start, stop, count(DISTINCT tseq) AS n, max(tseq) AS newest FROM c JOIN r ON b <= start AND e >= stop WHERE stop IS NOT NULL GROUP BY start, stop")(lambda s, d: tombstones.fragments(tombstones.ranges(plain(s, d))).select("start", "stop", F.size("seqs").cast("long").alias("n"), F.col("seqs")[0].alias("newest")))

# Merges

query("kv_merge_counter", counted())(lambda s, d: visibility.resolve(counters(s, d), merge=merge.Add(), has_ranges=False).select(*KV))
query("kv_merge_counter_snapshot", counted(f"seq <= {S_BIG}"))(lambda s, d: visibility.resolve(counters(s, d), S_BIG, merge=merge.Add(), has_ranges=False).select(*KV))
query("kv_merge_max", counted(value="CAST(max(CASE WHEN op <> 'DELETE' THEN v END) AS BIGINT)"))(lambda s, d: visibility.resolve(counters(s, d), merge=merge.Max(), has_ranges=False).select(*KV))
query("kv_merge_append", counted(value="string_agg(CASE WHEN op <> 'DELETE' THEN CAST(v AS VARCHAR) END, ',' ORDER BY x.seq)"))(lambda s, d: visibility.resolve(counters(s, d).withColumn("value", F.col("value").cast("string")), merge=merge.Append(","), has_ranges=False).select(*KV))


@query("kv_merge_u64_wrap", "WITH " + W_SQL + ", x AS (SELECT * FROM w), b AS (SELECT key, max(CASE WHEN op IN ('PUT', 'DELETE') THEN seq END) AS bseq FROM x GROUP BY key) SELECT x.key, CAST(sum(CASE WHEN op <> 'DELETE' THEN CAST(v AS HUGEINT) * 100000000000000 END) % 18446744073709551616 AS VARCHAR) AS value FROM x JOIN b USING (key) WHERE bseq IS NULL OR x.seq >= bseq GROUP BY x.key HAVING sum(CASE WHEN op <> 'DELETE' THEN v END) IS NOT NULL")
def _wrap(s, d):
    big = counters(s, d).withColumn("value", (F.col("value").cast("decimal(20,0)") * F.lit(10**14).cast("decimal(17,0)")).cast("decimal(38,0)"))
    return visibility.resolve(big, merge=merge.Wrap64Add(), has_ranges=False).select("key", F.col("value").cast("string").alias("value"))


@query("kv_merge_u64_bytes", counted())
def _u64(s, d):
    from .functions.codec import decode_u64, encode_u64

    raw = counters(s, d).withColumn("value", encode_u64(F.col("value").cast("decimal(38,0)")))
    return visibility.resolve(raw, merge=merge.UInt64Add(), has_ranges=False).select("key", decode_u64(F.col("value")).cast("long").alias("value"))


query("kv_partial_merge", f"WITH {W_SQL} SELECT key, CAST(floor((seq - 1) / 1000.0) AS BIGINT) AS file_no, max(seq) AS seq, count(*) AS n, CAST(sum(v) AS BIGINT) AS value FROM w WHERE op = 'MERGE' GROUP BY ALL")(lambda s, d: compaction.partial_merges(segmented(counters(s, d)), merge.Add()).select("key", "file_no", "seq", "n", "value"))
MERGED_RANGED = f"WITH {M_SQL}, k AS (SELECT m.*, (SELECT max(tseq) FROM r WHERE m.key >= b AND m.key < e) AS cover FROM m WHERE op <> 'RANGE_DELETE'), x AS (SELECT * FROM k WHERE cover IS NULL OR seq >= cover), bb AS (SELECT key, max(CASE WHEN op IN ('PUT', 'DELETE') THEN seq END) AS bseq FROM x GROUP BY key) SELECT x.key, CAST(sum(CASE WHEN op <> 'DELETE' THEN v END) AS BIGINT) AS value FROM x JOIN bb USING (key) WHERE bseq IS NULL OR x.seq >= bseq GROUP BY x.key HAVING sum(CASE WHEN op <> 'DELETE' THEN v END) IS NOT NULL"
query("kv_merge_range_delete", MERGED_RANGED)(lambda s, d: visibility.resolve(mixed(s, d), merge=merge.Add()).select(*KV))

# Scans

query("kv_prefix_fixed", latest(after="substr(key, 1, 9) = 'user00001'"))(lambda s, d: visibility.resolve(scan.seek_prefix(points(s, d), "user00001", 9), has_ranges=False).select(*KV))
query("kv_prefix_capped", latest(after="substr(key, 1, 8) = 'user0000' AND key >= 'user00002'"))(lambda s, d: visibility.resolve(scan.seek_prefix(points(s, d), "user00002", 8, fixed=False), has_ranges=False).select(*KV))
query("kv_range_scan", latest(after="key >= 'user000020' AND key < 'user000060'"))(lambda s, d: visibility.resolve(scan.between(points(s, d), "user000020", "user000060"), has_ranges=False).select(*KV))
query("kv_seek_limit", latest(after="key >= 'user000033'") + " ORDER BY key LIMIT 10")(lambda s, d: scan.seek(visibility.resolve(scan.between(points(s, d), "user000033"), has_ranges=False), "user000033", 10).select(*KV))
query("kv_reverse_topk", latest() + " ORDER BY key DESC LIMIT 10")(lambda s, d: scan.ordered(visibility.resolve(points(s, d), has_ranges=False), reverse=True, limit=10).select(*KV))
query("kv_seek_for_prev", latest(after="key <= 'user000050'") + " ORDER BY key DESC LIMIT 5")(lambda s, d: scan.seek_for_prev(visibility.resolve(points(s, d), has_ranges=False), "user000050", 5).select(*KV))
query("union_all_merge", "SELECT printf('user%06d', user_id) AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS run FROM events")(lambda s, d: scan.merged(*(events(s, d).filter(c).select(F.lit("default").alias("cf"), "key", "seq", F.lit(i).alias("run")) for i, c in enumerate(("event_type <> 'error'", "event_type = 'error'")))).select("key", "seq", "run"))

# Batches and namespaces


@query("kv_batch_sequences", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS seq FROM conversations")
def _batches(s, d):
    from .sources.batch import assign_sequences

    c = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn")
    return assign_sequences(c, ["conv_id", "turn"], last=0).select("conv_id", "turn", "seq")


C_SQL = "c AS (SELECT event_type AS cf, printf('user%06d', user_id) AS key, event_id + 1 AS seq, props AS value FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC) AS rn FROM c)"
query("cf_latest", f"WITH {C_SQL} SELECT cf, key, value FROM h WHERE rn = 1")(lambda s, d: visibility.resolve(families(s, d), has_ranges=False).select("cf", "key", "value"))
query("cf_isolation_counts", f"WITH {C_SQL} SELECT cf, count(*) AS live FROM h WHERE rn = 1 GROUP BY cf")(lambda s, d: visibility.resolve(families(s, d), has_ranges=False).groupBy("cf").agg(F.count(F.lit(1)).alias("live")))


@query("cf_join", f"WITH {C_SQL} SELECT x.key, x.value AS clicked, y.value AS bought FROM h x JOIN h y USING (key) WHERE x.rn = 1 AND y.rn = 1 AND x.cf = 'click' AND y.cf = 'purchase'")
def _cf_join(s, d):
    live = visibility.resolve(families(s, d).filter("cf in ('click', 'purchase')"), has_ranges=False)
    side = lambda cf, name: live.filter(F.col("cf") == cf).select("key", F.col("value").alias(name))
    return side("click", "clicked").join(side("purchase", "bought"), "key")


# Files

query("sst_properties", f"WITH {A_SQL} SELECT CAST(floor((seq - 1) / 1000.0) AS BIGINT) AS file_no, count(*) AS num_entries, count(*) FILTER (op = 'DELETE') AS num_deletions, CAST(0 AS BIGINT) AS num_merges, count(*) FILTER (op = 'RANGE_DELETE') AS num_range_deletions, CAST(sum(strlen(key)) AS BIGINT) AS raw_key_size, CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) AS raw_value_size, min(seq) AS min_seq, max(seq) AS max_seq FROM a GROUP BY ALL")(lambda s, d: stats.properties(segmented(plain(s, d))).drop("cf"))
query("sst_key_ranges", f"WITH {P_SQL} SELECT file_no, min(key) AS smallest, max(key) AS largest, min(seq) AS min_seq, max(seq) AS max_seq FROM p GROUP BY file_no")(lambda s, d: stats.key_ranges(segmented(points(s, d))).drop("cf"))
query("memtable_usage", f"WITH {P_SQL} SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 8) AS BIGINT) AS bytes FROM p")(lambda s, d: stats.memory_usage(points(s, d)).select("bytes"))
SCORES = f"WITH {F_SQL}, s AS (SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY level), sc AS (SELECT *, CASE WHEN level = 0 THEN files / 4.0::DOUBLE ELSE bytes / 100000.0::DOUBLE END AS score FROM s) "
query("level_scores", SCORES + "SELECT level, files, bytes, score FROM sc")(lambda s, d: compaction.level_scores(files(s, d), 4, 100_000).drop("cf"))
query("level_pick", SCORES + "SELECT arg_max(level, score) AS level, max(score) AS score FROM sc WHERE score >= 1 HAVING count(*) > 0")(lambda s, d: compaction.pick_level(compaction.level_scores(files(s, d), 4, 100_000)).drop("cf"))
query("file_overlap", f"WITH {F_SQL} SELECT a.file_no, b.file_no AS other_no FROM f a JOIN f b ON a.smallest <= b.largest AND a.largest >= b.smallest WHERE a.level = 0 AND b.level = 1")(lambda s, d: compaction.overlaps(files(s, d).filter("level = 0"), files(s, d).filter("level = 1")).select("file_no", "other_no"))
query("base_level_keys", f"WITH {F_SQL}, deep AS (SELECT smallest, smallest || '5' AS largest FROM f WHERE level = 1) SELECT DISTINCT key FROM p WHERE NOT EXISTS (SELECT 1 FROM deep WHERE p.key >= smallest AND p.key <= largest)")(lambda s, d: compaction.base_level_keys(points(s, d).select("cf", "key").distinct(), files(s, d).filter("level = 1").select("cf", "smallest", F.concat("smallest", F.lit("5")).alias("largest"))).select("key"))
query("fifo_evict", f"WITH {F_SQL}, x AS (SELECT *, sum(size) OVER (ORDER BY file_no DESC) AS held, row_number() OVER (ORDER BY file_no DESC) AS age FROM f) SELECT file_no, CAST(size AS BIGINT) AS size FROM x WHERE held > 200000 AND age > 1")(lambda s, d: compaction.fifo_evict(files(s, d), 200_000).select("file_no", "size"))
query(
    "universal_pick",
    f"WITH {F_SQL}, x AS (SELECT file_no, CAST(size AS BIGINT) AS size, row_number() OVER (ORDER BY file_no DESC) AS pos, sum(size) OVER (ORDER BY file_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) OVER () AS runs, sum(size) OVER () AS total, first_value(size) OVER (ORDER BY file_no) AS oldest FROM f), y AS (SELECT *, coalesce(min(CASE WHEN before IS NOT NULL AND size * 100 > before * 101 THEN pos END) OVER (), runs + 1) AS stop FROM x) SELECT file_no, size, CASE WHEN (total - oldest) * 100 > oldest * 200 THEN 'space' ELSE 'ratio' END AS reason FROM y WHERE ((total - oldest) * 100 > oldest * 200 AND runs >= 2) OR (pos < stop AND stop - 1 >= 2)",
)(lambda s, d: compaction.universal_pick(files(s, d)).select("file_no", "size", "reason"))

# Compaction

KEPT = "WITH {p}, x AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM p) SELECT key, seq, op, value FROM x WHERE (newer IS NULL OR newer > {s}) AND NOT (op = 'DELETE' AND seq <= {s})"
ROW = ("key", "seq", "op", "value")
query("compact_full", KEPT.format(p=P_SQL, s=1 << 50))(lambda s, d: compaction.rewrite(points(s, d), 1 << 50, has_ranges=False).select(*ROW))
query("compact_pinned", KEPT.format(p=P_SQL, s=PINNED))(lambda s, d: compaction.rewrite(points(s, d), PINNED, live_snapshot=True, has_ranges=False).select(*ROW))
query(
    "compact_tombstones",
    f"WITH {R_SQL}, z AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE p.key >= b AND p.key < e AND p.seq < tseq AND tseq <= {PINNED})), x AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM z) SELECT key, seq, op, value FROM x WHERE (newer IS NULL OR newer > {PINNED}) AND NOT (op = 'DELETE' AND seq <= {PINNED}) UNION ALL SELECT b, tseq, 'RANGE_DELETE', NULL FROM r WHERE tseq > {PINNED}",
)(lambda s, d: compaction.rewrite(plain(s, d), PINNED, live_snapshot=True).select(*ROW))
query(
    "compact_merge_collapse",
    f"WITH {W_SQL}, mk AS (SELECT DISTINCT key FROM w WHERE op = 'MERGE'), lo AS (SELECT * FROM w WHERE seq <= {PINNED} AND key IN (SELECT key FROM mk)), b AS (SELECT key, max(CASE WHEN op IN ('PUT', 'DELETE') THEN seq END) AS bseq, arg_max(op, seq) AS nop FROM lo GROUP BY key), u AS (SELECT lo.*, bseq, nop FROM lo JOIN b USING (key) WHERE bseq IS NULL OR seq >= bseq) "
    f"SELECT key, max(seq) AS seq, 'PUT' AS op, CAST(sum(v) AS BIGINT) AS value FROM u WHERE nop = 'MERGE' GROUP BY key UNION ALL SELECT key, seq, op, v FROM u WHERE nop = 'PUT' UNION ALL SELECT key, seq, op, v FROM w WHERE seq > {PINNED} AND key IN (SELECT key FROM mk) "
    f"UNION ALL SELECT key, seq, op, v FROM (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM w WHERE key NOT IN (SELECT key FROM mk)) WHERE (newer IS NULL OR newer > {PINNED}) AND NOT (op = 'DELETE' AND seq <= {PINNED})",
)(lambda s, d: compaction.rewrite(counters(s, d), PINNED, merge=merge.Add(), live_snapshot=True, has_ranges=False).select(*ROW))

FILTERED = "WITH " + P_SQL + ", h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM p) SELECT key, {value} AS value FROM h WHERE rn = 1 AND op = 'PUT' AND {keep}"
_full = lambda s, d, how: compaction.rewrite(points(s, d), 1 << 50, how=how, has_ranges=False).select(*KV)
query("filter_remove_prefix", FILTERED.format(value="value", keep="NOT starts_with(value, '{\"k\": 1')"))(lambda s, d: _full(s, d, RemoveByValuePrefix('{"k": 1')))
query("filter_append_suffix", FILTERED.format(value="value || '!'", keep="TRUE"))(lambda s, d: _full(s, d, AppendSuffix("!")))
query("filter_factory_prefix", FILTERED.format(value="value", keep="NOT starts_with(key, 'user00000')"))(lambda s, d: _full(s, d, prefix_drop_factory("user00000")(Context())))
query(
    "filter_operand",
    f"WITH {W_SQL}, x AS (SELECT * FROM w WHERE NOT (op = 'MERGE' AND v % 2 = 0 AND v = 100)), b AS (SELECT key, max(CASE WHEN op IN ('PUT', 'DELETE') THEN seq END) AS bseq FROM x GROUP BY key) SELECT x.key, CAST(sum(CASE WHEN op <> 'DELETE' THEN v END) AS BIGINT) AS value FROM x JOIN b USING (key) WHERE bseq IS NULL OR x.seq >= bseq GROUP BY x.key HAVING sum(CASE WHEN op <> 'DELETE' THEN v END) IS NOT NULL",
)(lambda s, d: compaction.rewrite(counters(s, d), 1 << 50, merge=merge.Add(), how=RemoveOperandByValue(100), has_ranges=False).filter(F.col("op").isin(PUT, MERGE)).select(*KV))

# Transactions, recovery, checkpoints


@query("txn_conflicts", f"WITH {P_SQL}, ws AS (SELECT seq AS txn_id, seq - 50 AS begin_seq, key FROM p), l AS (SELECT key, max(seq) AS newest FROM p GROUP BY key) SELECT txn_id, ws.key FROM ws JOIN l USING (key) WHERE newest > begin_seq")
def _conflicts(s, d):
    p = points(s, d)
    ws = p.select(F.col("seq").alias("txn_id"), (F.col("seq") - 50).alias("begin_seq"), "cf", "key")
    return visibility.conflicts(ws, p).select("txn_id", "key")


@query("txn_ryow", f"WITH {P_SQL}, base AS (SELECT key, arg_max(value, seq) AS value, arg_max(op, seq) AS op FROM p WHERE seq <= {PINNED} GROUP BY key), pend AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM p WHERE seq > {PINNED} GROUP BY key) SELECT key, CASE WHEN pend.op IS NULL THEN base.value ELSE pend.value END AS value FROM (SELECT * FROM base WHERE op = 'PUT') base FULL JOIN pend USING (key) WHERE coalesce(pend.op, base.op) = 'PUT'")
def _ryow(s, d):
    p = points(s, d)
    pending = p.filter(F.col("seq") > PINNED).withColumn("ord", F.col("seq"))
    return visibility.overlay(pending, visibility.resolve(p, PINNED, has_ranges=False)).select(*KV)


query("recovery_dedupe", counted())(lambda s, d: visibility.resolve(visibility.deduped(counters(s, d).unionByName(counters(s, d).filter("seq > 100"))), merge=merge.Add(), has_ranges=False).select(*KV))


@query("recovery_segments", latest())
def _replay(s, d):
    """Segments before the third were flushed; the log is replayed from the second on, so that one comes twice."""
    p = segmented(points(s, d))
    flushed = compaction.rewrite(p.filter("file_no < 3").drop("file_no"), 1 << 50, keep_tombstones=True, has_ranges=False)
    return visibility.resolve(visibility.deduped(flushed.unionByName(p.filter("file_no >= 2").drop("file_no"))), has_ranges=False).select(*KV)


def _loaded(store, log: DataFrame, cf: str = "default") -> None:
    """Bulk load in the order of the log's sequences."""
    store.ingest(log.select("key", "op", "value", "end_key", F.col("seq").alias("at")), cf, ["at"])


@query("checkpoint_isolation", latest(f"seq <= {S_BIG}"))
def _checkpoint(s, d):
    """A checkpoint of the store, opened on its own after the store went on."""
    from .session import scratch
    from .sources.store import KVStore

    folder, p = scratch(s, "checkpoint"), points(s, d)
    with KVStore.open(s, f"{folder}/db") as db:
        _loaded(db, p.filter(F.col("seq") <= S_BIG))
        db.checkpoint(f"{folder}/copy")
        _loaded(db, p.filter(F.col("seq") > S_BIG))
        db.compact()
    return KVStore.open(s, f"{folder}/copy", read_only=True).scan().select(*KV)


@query("store_range_scan", RANGED.format(r=R_SQL, s=1 << 50) + " AND key >= 'user000005' ORDER BY key")
def _store_scan(s, d):
    """Loaded in two files, the older one compacted before."""
    from .session import scratch
    from .sources.store import KVStore

    with KVStore.open(s, f"{scratch(s, 'store')}/db") as db:
        _loaded(db, plain(s, d).filter(F.col("seq") <= PINNED))
        db.compact()
        _loaded(db, plain(s, d).filter(F.col("seq") > PINNED))
        return db.scan(begin="user000005").select(*KV)


@query("cf_drop", f"WITH {C_SQL} SELECT cf, key, value FROM h WHERE rn = 1 AND cf <> 'view'")
def _drop(s, d):
    """A namespace that was dropped and made again is empty."""
    from functools import reduce

    from .session import scratch
    from .sources.store import KVStore

    log = families(s, d)
    names = sorted(r.cf for r in log.select("cf").distinct().collect())
    with KVStore.open(s, f"{scratch(s, 'families')}/db") as db:
        for name in names:
            db.create_column_family(name)
            _loaded(db, log.filter(F.col("cf") == name), name)
        db.drop_column_family("view")
        db.create_column_family("view")
        return reduce(DataFrame.unionByName, (db.scan(cf=name).select(F.lit(name).alias("cf"), *KV) for name in names))


@query("txn_commit", "WITH " + P_SQL + ", k AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in GET) + "]) AS key) SELECT key, NOT EXISTS (SELECT 1 FROM p WHERE p.key = k.key AND p.seq > " + str(PINNED) + ") AS committed FROM k")
def _commit(s, d):
    """One transaction a key, begun before the rest of the log came; who comes second on a key is refused."""
    from .errors import Busy
    from .session import scratch
    from .sources.store import KVStore
    from .sources.transactions import TransactionDB

    p, done = points(s, d), []
    with KVStore.open(s, f"{scratch(s, 'txn')}/db") as db:
        _loaded(db, p.filter(F.col("seq") <= PINNED))
        begun = []
        for key in GET:
            begun.append(TransactionDB(db).optimistic())
            begun[-1].put(key, "mine")
        _loaded(db, p.filter(F.col("seq") > PINNED))
        for key, txn in zip(GET, begun, strict=True):
            try:
                txn.commit()
                done.append((key, True))
            except Busy:
                done.append((key, False))
    return s.createDataFrame(done, "key string, committed boolean")


@query("kv_window_versions", f"WITH {P_SQL} SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM p")
def _versions(s, d):
    by = W.partitionBy("cf", "key").orderBy(F.col("seq").desc())
    return points(s, d).select("key", "seq", F.row_number().over(by).cast("long").alias("version"), F.lag("seq").over(by).alias("newer"))


@query("trailer_codec", "SELECT event_id + 1 AS seq, ((event_id + 1) << 8) | 1 AS trailer, event_id + 1 AS back, CAST(1 AS BIGINT) AS code, printf('%06d.log', event_id) AS name, event_id AS number FROM events")
def _codec(s, d):
    from .functions import codec

    t = codec.pack_trailer(F.col("seq"), F.lit(1).cast("long"))
    seq, code = codec.unpack_trailer(F.col("trailer"))
    name = codec.file_name(F.col("seq") - 1, "log")
    return events(s, d).select("seq", t.alias("trailer"), name.alias("name")).select("seq", "trailer", seq.alias("back"), code.alias("code"), "name", codec.log_number(F.col("name")).alias("number"))


@query("stream_tail_latest", RANGED.format(r=R_SQL, s=1 << 50))
def _tail(s, d):
    from .streaming.tail import drain

    return drain(plain(s, d)).select(*KV)


@query("stream_tail_merge", MERGED_RANGED)
def _tail_merge(s, d):
    from .streaming.tail import drain

    return drain(mixed(s, d), merge.Add()).select(*KV)
