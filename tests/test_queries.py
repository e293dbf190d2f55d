"""Every query of the engine against its SQL in another engine, over the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from tidelog import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, (float, Decimal)) else v


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in queries.ORACLES:
        assert got
        return
    answer = db.execute(queries.ORACLES[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in answer.fetchall()), key=repr)
    assert len(got) == len(want) and all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_stream_equals_batch(spark):
    for name, batch in (("stream_tail_latest", "kv_delete_range"), ("stream_tail_merge", "kv_merge_range_delete")):
        tail = {tuple(r) for r in queries.QUERIES[name](spark, DATA).collect()}
        assert tail == {tuple(r) for r in queries.QUERIES[batch](spark, DATA).collect()}


def test_key_filters_reach_the_files(spark):
    spark.createDataFrame([("default", f"k{i:03d}", i, "PUT", "v", None) for i in range(10)], "cf string, key string, seq long, op string, value string, end_key string").write.mode("overwrite").parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/pushed")
    from tidelog.operators import visibility

    df = visibility.get(spark.read.parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/pushed"), ["k001"], snapshot=5, has_ranges=False)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = df._jdf.queryExecution().toString()
    assert "LessThanOrEqual(seq,5)" in plan and "EqualTo(key,k001)" in plan and "ReadSchema: struct<cf:string,key:string,seq:bigint,op:string,value:string>" in plan
