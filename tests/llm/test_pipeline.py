"""The pipeline against its stages' plain meaning."""

from collections import Counter

import corpus_pipeline
from tidelog.llm import jaccard_join, mixing, pieces, quality, secrets_scan
from tidelog.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = quality.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = quality.judge([r.text for r in rows], model)["kept"]
    rows = [r for r, k in zip(rows, kept, strict=True) if k]
    from test_text_operators import plain_classes

    classes = plain_classes(rows)
    rows = [r.asDict() for r in rows if classes[r.doc_id][0] == r.doc_id]
    for r in rows:
        r["text"] = secrets_scan.redact(r["text"], secrets_scan.scan(r["text"]))
        r["n_chars"] = len(r["text"])
    left = spark.createDataFrame(rows, docs.schema)
    times = Counter(r.doc_id for r in mixing.remixed(left).collect())
    taken = {r.doc_id: r for r in mixing.mix(left).collect()}
    assert all(abs(times[d] - t.taken / max(1, t.size)) < 1 for d, t in taken.items())
    c = pieces.codec(Q.piece_model())
    want = Counter({(r["doc_id"], len(c.library.encode(r["text"]))): times[r["doc_id"]] for r in rows if times[r["doc_id"]]})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want and sum(want.values()) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_of_each_keeps_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "z"), (3, None)], "doc_id long, text string")
    assert Counter(r.doc_id for r in jaccard_join.one_of_each(df).collect()) == {1: 1, None: 1, 3: 1}


def test_one_of_each_by_id_and_text(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h  i j k l"), (None, "z z"), (None, "z  z"), (None, "y"), (4, near), (4, near + " x"), (None, near)]
    got = Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    near_kept = [x for x in got if x[0] == 4]
    assert len(near_kept) == 1 and got == Counter([(1, "a b c d e f"), (1, "g h i j k l"), (None, "z  z"), (None, "y"), *near_kept])


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing names; clean rows stay."""
    clean = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    long = " ".join(f"wort{i}" for i in range(60_000))
    names = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, size long, taken long, class string, _size long"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "k", "r", 1, 2, "c", 3) for r in clean]
    rows += [(None, None, None, None, None, None, None, None, None, None, None), (1001, "", None, "s", 0, "k", "r", 1, 2, "c", 3), (1002, long, "de", None, len(long), None, "r", 1, 2, "c", 3)]
    rows += [(1003, clean[0].text, "de", "s", 5, "k", "r", 1, 2, "c", 3)] * 3
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and (name == "n-gram Jaccard join" or any(r.doc_id == 1002 for r in got)), name
        assert all(r.key in ("k", None) and r["class"] in ("c", None) and r._size in (3, None) for r in got)
    assert {r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs, SF).collect()} >= {1002, 1001}
    assert corpus_pipeline.encoding_stage(spark, docs, SF).count() == len(rows)


def test_folders_of_earlier_stages_go(spark):
    import os

    from tidelog.llm.common import shared_folder

    root = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    corpus_pipeline.run(spark, SF).count()
    left = [x for x in set(os.listdir(root)) - before if x.startswith("pipeline-")]
    assert len(left) == 1 and os.listdir(f"{root}/{left[0]}") == [str(len(corpus_pipeline.STAGES) - 1)]
