"""The mix as SQL for another engine; the parameters are those of mixing."""

from .mixing import BLOCK_WORDS, FAN, SEED, SHARD_WORDS, WEIGHTS


def _hash(*parts: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:' || {' || chr(58) || '.join(parts)}), 1, 8) AS BIGINT)"


def _apportion(out: str, source: str, within: str, share: str, seats: str, order: str, keep: str) -> str:
    """CTEs that add quota to source: whole sure seats, then the highest quotients inside the band."""
    over = f"OVER (PARTITION BY {within})" if within else "OVER ()"
    rank = f"PARTITION BY {within} " if within else ""
    return f"""
{out}_b AS (SELECT *, CASE WHEN sum({share}) {over} > 0 THEN {share} / sum({share}) {over} ELSE 0.0::DOUBLE END AS part, count(*) {over} AS rivals, CAST({seats} AS BIGINT) AS seats FROM {source}),
{out}_c AS (SELECT *, CAST(floor(part * seats) AS BIGINT) AS whole, CAST(ceil(part * rivals / 2) + 2 AS BIGINT) AS band FROM {out}_b),
{out}_d AS (SELECT *, greatest(0, whole - band) AS sure FROM {out}_c),
{out}_e AS (SELECT *, seats - sum(sure) {over} AS open_seats FROM {out}_d),
{out}_f AS (SELECT *, unnest(range(sure + 1, whole + band + 2)) AS k FROM {out}_e),
{out}_g AS (SELECT *, row_number() OVER ({rank}ORDER BY {share} / (2 * k - 1)::DOUBLE DESC, {order}, k) <= open_seats AND {share} > 0 AS won FROM {out}_f),
{out} AS (SELECT {keep}, CAST(any_value(sure) + sum(CASE WHEN won THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM {out}_g GROUP BY {keep})"""


_weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
_before = lambda at: (
    f"(floor((floor({at} / {BLOCK_WORDS}) * rest + turn) / n) * {BLOCK_WORDS} + ({at} - floor({at} / {BLOCK_WORDS}) * {BLOCK_WORDS}) * (floor(((floor({at} / {BLOCK_WORDS}) + 1) * rest + turn) / n) - floor((floor({at} / {BLOCK_WORDS}) * rest + turn) / n)))"
)

MIX_SQL = (
    f"""
WITH s AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))) AS name, coalesce('s' || source, '') AS id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT id, source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY id, source),
w AS (SELECT *, {_weight} AS weight, 2 * source_size AS cap FROM t),
l AS (SELECT *, CAST(sum(source_size) OVER () * 150 - 100 * coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / ((sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 100) AS level FROM w),
g AS (SELECT id, source, source_size, CASE WHEN level * weight >= cap THEN CAST(cap AS DOUBLE) ELSE (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight < cap) * weight END AS target FROM l),"""
    + _apportion("q", "g", "", "target", f"ceil(sum(target) OVER () / {BLOCK_WORDS})", "source NULLS LAST", "id, source, source_size, target")
    + f""",
src AS (SELECT *, CAST(greatest(1, ceil(source_size / {SHARD_WORDS})) AS BIGINT) AS shards FROM q),
d AS (SELECT s.doc_id, s.size, src.id, source_size, target, src.quota AS source_quota, {_hash("'doc'", "s.name")} % shards AS shard, {_hash("'spot'", "s.name")} AS spot FROM s JOIN src ON s.id = src.id),
h AS (SELECT id, shard, CAST(floor(shard / {FAN}) AS BIGINT) AS grp, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_quota) AS source_quota FROM d GROUP BY id, shard),
u AS (SELECT id, grp, CAST(sum(shard_size) AS BIGINT) AS group_size, any_value(source_quota) AS source_quota FROM h GROUP BY id, grp),"""
    + _apportion("uq", "u", "id", "group_size", "source_quota", "grp", "id, grp, group_size, source_quota")
    + """,
hu AS (SELECT h.id, h.shard, h.grp, h.shard_size, uq.quota AS group_quota FROM h JOIN uq ON h.id = uq.id AND h.grp = uq.grp),"""
    + _apportion("hq", "hu", "id, grp", "shard_size", "group_quota", "shard", "id, shard, grp, shard_size, group_quota")
    + f""",
hn AS (SELECT id, shard, CAST(ceil(shard_size / {BLOCK_WORDS}) AS BIGINT) AS n, quota FROM hq),
hp AS (SELECT id, shard, n, CASE WHEN n > 0 THEN CAST(floor(least(quota, n * 2) / n) AS BIGINT) ELSE 0 END AS passes, least(quota, n * 2) AS q2 FROM hn),
hr AS (SELECT id, shard, n, passes, q2 - passes * n AS rest, CASE WHEN n > 0 THEN {_hash("'turn'", "id", "CAST(shard AS VARCHAR)")} % n ELSE 0 END AS turn FROM hp),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY id, shard ORDER BY spot, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM d)
SELECT doc_id, size, source_size, target, CASE WHEN n > 0 THEN CAST(passes * size + {_before("stop")} - {_before("(stop - size)")} AS BIGINT) ELSE 0 END AS taken
FROM p JOIN hr ON p.id = hr.id AND p.shard = hr.shard
"""
)
