"""Literal cases, and random logs against a sequential fold."""

import random

import pytest

from tidelog.errors import Corruption, InvalidArgument, MergeOperatorNotConfigured
from tidelog.functions import codec
from tidelog.operators import compaction, merge, scan, tombstones, visibility
from tidelog.operators.filters import AppendSuffix, RemoveByValuePrefix, RemoveOperandByValue
from tidelog.schema import Options
from tidelog.sources.batch import WriteBatch, assign_sequences

LOG = "cf string, key string, seq long, op string, value {}, end_key string"


def log(spark, rows, kind="string"):
    """rows: (op, key, value or end)."""
    out = [("default", k, i, op, None if op in ("DELETE", "RANGE_DELETE") else v, v if op == "RANGE_DELETE" else None) for i, (op, k, v) in enumerate(rows, 1)]
    return spark.createDataFrame(out, LOG.format(kind))


def live(df):
    return {r.key: r.value for r in df.collect()}


def fold(rows, upto=None):
    state = {}
    for i, (op, k, v) in enumerate(rows, 1):
        if upto is not None and i > upto:
            break
        if op == "PUT":
            state[k] = v
        elif op == "DELETE":
            state.pop(k, None)
        elif op == "MERGE":
            state[k] = state.get(k, 0) + v
        else:
            state = {x: y for x, y in state.items() if not k <= x < v}
    return state


def ops(seed, n, keys, kinds, value):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        op = r.choices(list(kinds), list(kinds.values()))[0]
        a, b = sorted((r.randrange(keys), r.randrange(keys)))
        rows.append((op, f"key{a:03d}", f"key{b + 1:03d}" if op == "RANGE_DELETE" else value(r)))
    return rows


def test_snapshots_and_ranges(spark):
    rows = [("PUT", x, x + "v") for x in "abcde"] + [("RANGE_DELETE", "b", "d"), ("PUT", "c", "c2"), ("RANGE_DELETE", "z", "a")]
    df = log(spark, rows)
    assert live(visibility.resolve(df)) == {"a": "av", "c": "c2", "d": "dv", "e": "ev"}
    assert live(visibility.resolve(df, 5)) == {x: x + "v" for x in "abcde"}
    assert live(visibility.get(df, ["b", "c", "nope"])) == {"c": "c2"}
    assert live(visibility.get(df, ["b"], snapshot=5)) == {"b": "bv"}


def test_fragments(spark):
    t = spark.createDataFrame([("x", "a", "e", 5), ("x", "c", "g", 20)], "cf string, begin string, end string, tseq long")
    got = {(r.start, r.stop): list(r.seqs) for r in tombstones.fragments(t).collect()}
    assert got == {("a", "c"): [5], ("c", "e"): [20, 5], ("e", "g"): [20]}
    p = spark.createDataFrame([("x", k, 1) for k in "bcdfz"], "cf string, key string, seq long")
    for bounds in (["a", "c", "e", "g"], ["d"], ["b", "f"], None):
        buckets = bounds and tombstones.Buckets(bounds)
        assert {(r.start, r.stop): list(r.seqs) for r in tombstones.fragments(t, buckets).collect()} == got
        assert {r.key: r.cover for r in tombstones.cover(p, t, buckets).collect()} == {"b": 5, "c": 20, "d": 20, "f": 20, "z": None}


@pytest.mark.parametrize("binary", [False, True])
def test_cover_equals_brute_force_in_many_buckets(spark, binary):
    r = random.Random(7)
    name = (lambda i: f"k{i:04d}é".encode()) if binary else (lambda i: f"k{i:04d}é")
    tombs = []
    for i in range(400):
        a = r.randrange(1000)
        tombs.append((r.choice("xy"), name(a), name(a + r.choice((1, 3, 40, 900))), i))
    kind = "binary" if binary else "string"
    t = spark.createDataFrame([(c, bytearray(a) if binary else a, bytearray(b) if binary else b, s) for c, a, b, s in tombs], f"cf string, begin {kind}, end {kind}, tseq long")
    keys = [(c, name(i), i) for c in "xyz" for i in range(0, 2000, 3)]
    p = spark.createDataFrame([(c, bytearray(k) if binary else k, s) for c, k, s in keys], f"cf string, key {kind}, seq long")
    buckets = tombstones.Buckets.of(t)
    assert len(buckets.coarse) > 4
    covered = tombstones.cover(p, t, buckets)
    assert "NestedLoop" not in covered._jdf.queryExecution().toString() and "Cartesian" not in covered._jdf.queryExecution().toString()
    want = {(c, k): max((s for f, a, b, s in tombs if f == c and a <= k < b), default=None) for c, k, _ in keys}
    assert {(x.cf, bytes(x.key) if binary else x.key): x.cover for x in covered.collect()} == want
    cells = tombstones.fragments(t, buckets).collect()
    assert {(x.cf, bytes(x.start) if binary else x.start): list(x.seqs) for x in cells} == {
        (f, a): sorted((s for g, b, e, s in tombs if g == f and b <= a < e), reverse=True) for f in "xy" for a in sorted({z for g, b, e, _ in tombs if g == f for z in (b, e)}) if any(g == f and b <= a < e for g, b, e, _ in tombs)
    }


def test_wide_tombstones_over_many_buckets(spark):
    """Tombstones over any number of whole buckets, against all pairs; the tombstones are read once."""
    r, keys = random.Random(5), [f"k{i:03d}" for i in range(200)]
    tombs = [(r.choice("xy"), *sorted(r.sample(keys, 2)), seq) for seq in r.sample(range(1, 10_000), 150)]
    points = [(cf, key) for cf in "xyz" for key in [*keys, "a", "z"]]
    want = {(cf, key): max((s for c, b, e, s in tombs if c == cf and b <= key < e), default=None) for cf, key in points}
    t, p = spark.createDataFrame(tombs, "cf string, begin string, end string, tseq long"), spark.createDataFrame(points, "cf string, key string")
    for buckets in (None, tombstones.Buckets(["k050"]), tombstones.Buckets(keys[::3]), tombstones.Buckets(keys)):
        assert {(x.cf, x.key): x.cover for x in tombstones.cover(p, t, buckets).collect()} == want
    wide = spark.createDataFrame([("x", "k000", "k199", 7)], t.schema)
    plan = tombstones.pieces(wide, tombstones.Buckets(keys))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_coarse_bounds_are_cut_further_and_a_key_searches_its_steps(spark):
    """Bounds given may leave all tombstones in one bucket; and a key compares with the log of a bucket's pieces, not with all."""
    r, keys = random.Random(13), [f"k{i:04d}" for i in range(1200)]
    tombs = []
    for seq in r.sample(range(1, 10_000), 700):
        a = r.randrange(1190)
        tombs.append((r.choice("xy"), keys[a], keys[min(a + r.choice((1, 2, 5, 60, 1100)), 1199)], seq))
    points = [(cf, key) for cf in "xyz" for key in [*keys, "a", "k0003x", "z"]]
    want = {(cf, key): max((s for c, b, e, s in tombs if c == cf and b <= key < e), default=None) for cf, key in points}
    t, p = spark.createDataFrame(tombs, "cf string, begin string, end string, tseq long"), spark.createDataFrame(points, "cf string, key string")
    coarse = tombstones.Buckets(["a0"])
    fine = tombstones.Buckets.of(t, given=coarse)
    assert "a0" in fine.bounds and fine.exact and tombstones.Buckets.of(t, given=fine) is fine
    few = tombstones.Buckets.of(t, 3, given=coarse)
    assert len(few.bounds) <= 4 and not few.exact
    for buckets in (coarse, few, tombstones.Buckets.of(t, 40)):
        assert {(x.cf, x.key): x.cover for x in tombstones.cover(p, t, buckets).collect()} == want
    rows = tombstones.steps(t, few).collect()
    assert all([s.at or "" for s in x.steps] == sorted({s.at or "" for s in x.steps}) for x in rows)
    assert max(len(x.steps) for x in rows) > 200 and max(len(x.jumps) for x in rows) <= 11
    # bounds sampled from other tombstones are bounds like any others
    other = spark.createDataFrame([("x", "b", "c", 1)], t.schema)
    assert {(x.cf, x.key): x.cover for x in tombstones.cover(p, t, tombstones.Buckets.of(other)).collect()} == want


def test_hot_counter_is_folded_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(visibility, "STRETCH", 7)
    rows = ops(11, 600, 3, {"MERGE": 90, "PUT": 6, "DELETE": 4}, lambda r: r.randrange(1000))
    assert live(visibility.resolve(log(spark, rows, "long"), merge=merge.Add())) == fold(rows)
    assert live(visibility.resolve(log(spark, rows, "long"), 311, merge=merge.Add())) == fold(rows, 311)


def test_newest_merge_without_an_operator_is_refused(spark):
    with pytest.raises(Exception, match="MergeOperatorNotConfigured"):
        visibility.resolve(log(spark, [("PUT", "a", "1"), ("MERGE", "a", "2")])).collect()
    assert live(visibility.resolve(log(spark, [("MERGE", "a", "1"), ("PUT", "a", "2")]))) == {"a": "2"}


def test_as_of_pairs_no_probe_with_other_versions(spark):
    r = random.Random(3)
    puts = [("x", f"k{r.randrange(5)}", i, r.choice(("PUT", "DELETE")), f"v{i}", None) for i in range(1, 300)]
    probes = [("x", f"k{r.randrange(6)}", r.randrange(320), f"p{i}") for i in range(100)] + [("y", "k1", 5, "p"), ("x", "k1", None, "q")]
    df = spark.createDataFrame(puts, LOG.format("string"))
    found = visibility.as_of(spark.createDataFrame(probes, "cf string, key string, at long, seq string"), df)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for c, k, at, name in probes:
        best = max((s for f, key, s, op, _, _ in puts if at is not None and f == c and key == k and op == "PUT" and s <= at), default=None)
        want[name] = (best, best and f"v{best}")
    assert {x.seq: (x.found_seq, x.value) for x in found.collect()} == want


def test_rewrite_reads_the_log_once(spark, tmp_path):
    rows = ops(12, 200, 20, {"MERGE": 50, "PUT": 30, "DELETE": 20}, lambda r: r.randrange(9))
    log(spark, rows, "long").write.parquet(f"{tmp_path}/log")
    out = compaction.rewrite(spark.read.parquet(f"{tmp_path}/log").filter("op <> 'RANGE_DELETE'"), 100, merge.Add(), has_ranges=False)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_merges(spark):
    rows = [("PUT", "a", 10), ("MERGE", "a", 1), ("MERGE", "a", 2), ("MERGE", "b", 5), ("MERGE", "b", 5), ("PUT", "d", 42), ("MERGE", "e", 7), ("DELETE", "e", None)]
    df = log(spark, rows, "long")
    assert live(visibility.resolve(df, merge=merge.Add())) == {"a": 13, "b": 10, "d": 42}
    assert live(visibility.resolve(df, 2, merge=merge.Add())) == {"a": 11}
    with pytest.raises(MergeOperatorNotConfigured):
        visibility.resolve(df, has_merges=True)
    text = log(spark, [("PUT", "k", "a"), ("MERGE", "k", "b"), ("MERGE", "k", "x"), ("MERGE", "k", "c"), ("MERGE", "k", "x"), ("MERGE", "k", "d")])
    assert live(visibility.resolve(text, merge=merge.Append())) == {"k": "abxcxd"}
    out = compaction.rewrite(text, 100, merge.Append(), RemoveOperandByValue("x"))
    assert [(r.op, r.value, r.seq) for r in out.collect()] == [("PUT", "abcd", 6)]


def test_u64_wraps(spark):
    big = (2**64 - 1).to_bytes(8, "little")
    rows = [("PUT", "a", bytearray(big)), ("MERGE", "a", bytearray((2).to_bytes(8, "little"))), ("MERGE", "b", bytearray(b"odd"))]
    got = live(visibility.resolve(log(spark, rows, "binary"), merge=merge.UInt64Add()))
    assert {k: int.from_bytes(v, "little") for k, v in got.items()} == {"a": 1, "b": 0}


@pytest.mark.parametrize(
    "seed,n,keys,kinds,counts",
    [(1, 2000, 200, {"PUT": 70, "DELETE": 30}, False), (2, 3000, 40, {"MERGE": 60, "PUT": 25, "DELETE": 15}, True), (3, 2000, 60, {"PUT": 55, "DELETE": 20, "RANGE_DELETE": 25}, False), (4, 2000, 60, {"PUT": 30, "MERGE": 40, "DELETE": 15, "RANGE_DELETE": 15}, True)],
)
def test_model(spark, seed, n, keys, kinds, counts):
    rows = ops(seed, n, keys, kinds, (lambda r: r.randrange(1000)) if counts else (lambda r: "".join(r.choices("abcdefgh", k=r.randint(1, 24)))))
    df = log(spark, rows, "long" if counts else "string").cache()
    how = merge.Add() if counts else None
    for s in (n // 3, n):
        assert live(visibility.resolve(df, s, merge=how)) == fold(rows, s)
    pinned = n // 2
    small = compaction.rewrite(df, pinned, how, live_snapshot=True).cache()
    assert small.count() < df.count()
    for s in (pinned, pinned + 7, n):
        assert live(visibility.resolve(small, s, merge=how)) == fold(rows, s)


def test_tail_of_late_files_and_merges(spark, tmp_path):
    """Segments in any order of arrival, one of them twice, with range deletes and merges."""
    from tidelog.streaming import tail

    rows = ops(9, 800, 30, {"PUT": 30, "MERGE": 40, "DELETE": 15, "RANGE_DELETE": 15}, lambda r: r.randrange(100))
    df, parts, folder = log(spark, rows, "long"), list(range(8)), f"file://{tmp_path}"
    random.Random(2).shuffle(parts)
    for k in [*parts, parts[0]]:
        df.filter(f"floor((seq - 1) / 100) = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/log")
        tail.materialise(tail.follow(spark, f"{folder}/log", df.schema, 1), f"{folder}/out", f"{folder}/state").awaitTermination()
    assert live(tail.view(spark, f"{folder}/out", df.schema, merge.Add())) == fold(rows)
    assert tail.compact(spark, f"{folder}/out", f"{folder}/one", df.schema).count() < len(rows)
    assert live(tail.view(spark, f"{folder}/one", df.schema, merge.Add())) == fold(rows)


def test_filters(spark):
    df = log(spark, [("PUT", "a", "DELme"), ("PUT", "b", "keep-b"), ("PUT", "c", "DELme-too"), ("PUT", "d", "keep-d")])
    assert live(compaction.rewrite(df, 10, how=RemoveByValuePrefix("DEL"))) == {"b": "keep-b", "d": "keep-d"}
    assert live(compaction.rewrite(df, 3, how=AppendSuffix("!"), live_snapshot=True)) == {"a": "DELme", "b": "keep-b", "c": "DELme-too", "d": "keep-d!"}


def test_scans(spark):
    df = spark.createDataFrame([("x", k, k) for k in ("aa1", "aa2", "bb1")], "cf string, key string, value string")
    keys = lambda d: [r.key for r in d.orderBy("key").collect()]
    assert keys(scan.seek_prefix(df, "aa", 2)) == ["aa1", "aa2"]
    assert keys(scan.seek_prefix(df, "a", 2)) == ["aa1", "aa2", "bb1"]
    assert keys(scan.seek_prefix(df, "a", 2, fixed=False)) == ["aa1", "aa2"]
    assert [r.key for r in scan.seek_for_prev(df, "b", 1).collect()] == ["aa2"]
    assert codec.successor(b"a\xff") == b"b" and codec.successor(b"\xff") is None and codec.successor("a") == "b"


def test_codecs():
    assert codec.crc32c(b"123456789") == 0xE3069283 and codec.unmask_crc(codec.mask_crc(0x12345678)) == 0x12345678
    for n in (0, 127, 128, 300, 2**64 - 1):
        assert codec.get_varint(codec.put_varint(n)) == (n, len(codec.put_varint(n)))
    assert codec.get_slice(codec.put_slice(b"abc")) == (b"abc", 4)
    for width in (4, 8):
        assert codec.get_fixed(b"x" + codec.put_fixed(300, width), 1, width) == 300
    assert codec.short_successor(b"\xffab") == b"\xffb" and codec.short_successor(b"\xff") == b"\xff"
    with pytest.raises(Corruption):
        codec.get_fixed(b"abc", 0, 4)
    with pytest.raises(Corruption):
        codec.get_varint(b"\xff" * 11)
    with pytest.raises(InvalidArgument):
        Options(compression="rot13")
    a, b = b"abcdef", b"abzz"
    assert a <= codec.separator(a, b) < b


def test_bloom_filters():
    from tidelog.functions import bloom

    assert bloom.bloom_hash(b"") == bloom.SEED and bloom.bloom_hash(b"abcd") != bloom.bloom_hash(b"abce")
    # the published vectors of the hash
    for data, want in ((b"\x62", 0xEF1345C4), (b"\xc3\x97", 0x5B663814), (b"\xe2\x99\xa5", 0x323C078F), (b"\xe1\x80\xb9\x32", 0xED21633A)):
        assert bloom.bloom_hash(data, 0xBC9F1D34) == want
    keys = [f"key{i}".encode() for i in range(5000)]
    held = bloom.build(keys)
    assert all(bloom.may_hold(k, held) for k in keys) and len(held) == 5000 * 10 // 8 + 1
    assert sum(bloom.may_hold(f"other{i}".encode(), held) for i in range(5000)) < 150
    assert not bloom.may_hold(b"a", b"\0") and bloom.may_hold(b"a", b"\0\0\x1f") and not bloom.may_hold(b"a", bloom.build([]))


def test_batches(spark):
    b = WriteBatch(sequence=7).put("a", "1").delete("b").merge("c", "2").delete_range("d", "e")
    assert [(r[1], r[2], r[3]) for r in b.rows()] == [("a", 7, "PUT"), ("b", 8, "DELETE"), ("c", 9, "MERGE"), ("d", 10, "RANGE_DELETE")]
    c = WriteBatch(sequence=3).put("é", b"\x00\xff")
    assert WriteBatch.of(c.contents()) == c and c.byte_size() == 12 + 1 + 2 + 2
    with pytest.raises(Corruption):
        WriteBatch.of(b"[1")
    seen = []
    b.iterate({"PUT": lambda *x: seen.append(x)}, count=4)
    assert seen == [("default", "a", "1", None)]
    with pytest.raises(Corruption):
        b.iterate({}, count=3)
    df = assign_sequences(spark.range(1000).selectExpr("(id * 7919) % 1000 id"), ["id"], last=10, partitions=5)
    assert [(r.id, r.seq) for r in df.orderBy("id").collect()] == [(i, i + 11) for i in range(1000)]


def test_sequences_of_many_rows_are_dense(spark, tmp_path):
    """More rows than the ranges are sampled from, with columns that the counts do not need."""
    spark.range(120_000).selectExpr("hash(id) k", "id", "repeat(cast(id as string), 3) v").write.parquet(f"{tmp_path}/in")
    assign_sequences(spark.read.parquet(f"{tmp_path}/in"), ["k", "id"], last=5, partitions=9).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("k", "id").select("seq", "id", "v").collect()
    assert [r.seq for r in rows] == list(range(6, 120_006)) and all(r.v == str(r.id) * 3 for r in rows)


def test_pickers(spark):
    f = spark.createDataFrame([("x", 0, i, s, "a", "z", i, i) for i, s in enumerate((1000, 100, 50, 50), 1)], "cf string, level int, file_no long, size long, smallest string, largest string, min_seq long, max_seq long")
    assert sorted(r.file_no for r in compaction.fifo_evict(f, 150).collect()) == [1, 2]
    assert sorted(r.file_no for r in compaction.fifo_evict(f, 1).collect()) == [1, 2, 3]
    assert {r.file_no for r in compaction.universal_pick(f).collect()} == {2, 3, 4}
    assert compaction.pick_level(compaction.level_scores(f)).first().level == 0
