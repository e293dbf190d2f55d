"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings (3 to 6 characters), each word once a text, screened to
those that toxic texts hold beyond chance, is trained in numpy from confirmed toxic texts and unlabelled ones.  Its risk is the positive risk times the class
prior plus the unlabelled negative risk less the prior times the positive texts' negative risk, that difference
kept from falling below zero (where it does, the step goes the other way).  Scores are calibrated on labelled
rows of the learning part, each scored by a classifier that was trained without its fold (FOLDS of them).  Labels are
read only of rows outside the held-out fold.

How many texts hold a feature is counted over all documents, fold by fold.  Positive, calibrating and, for the steps of the
classifier, unlabelled texts are bounded samples (FIT_POSITIVE, FIT_CALIBRATION and FIT_UNLABELLED rows, by hash of
doc_id); of these the driver is sent the screened features only, never a text.

Cases: null and empty texts score the calibrated intercept; repeated rows get equal rows; of an id with several texts
the greatest is learnt from; a score of just THRESHOLD is predicted; very long texts are scored whole; no toxic text to
learn from: every score is 0; too few for every fold to leave one: calibrated on the texts trained from; no rows, no
scores; further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, least_hashed, slices
from .grams import LETTERS, U, Batch, mix
from .quality import _sigmoid, calibrate

BITS = 18
FIT_POSITIVE, FIT_UNLABELLED, FIT_CALIBRATION = 1500, 3000, 1500
FOLDS = 3
THRESHOLD = 0.3
BEGINNINGS = (3, 4, 5, 6)
#: A bucket is used if its share of the toxic texts exceeds that of the unlabelled ones by so much and so many deviations.
LEAST_SHARE, LEAST_Z = 0.01, 4.0


def features(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the distinct words of each text, their beginnings and the text's distinct pairs."""
    words = b.words()
    keyed = mix(words + U(0x9E3779B97F4A7C15) * b.owner.astype(np.uint64))
    _, first = np.unique(keyed, return_index=True)
    owner, start, end = b.owner[first], b.start[first], b.end[first]
    out = [(owner, words[first])]
    points = np.flatnonzero((b.raw & 0xC0) != 0x80)
    index = np.searchsorted(points, start)
    for k in BEGINNINGS:
        stop = points[np.minimum(index + k, len(points) - 1)] if len(points) else index
        longer = stop < end
        out.append((owner[longer], mix(b.hash_of(start[longer], stop[longer]) + U(k))))
    owners, hashes = np.concatenate([o for o, _ in out]), np.concatenate([h for _, h in out])
    return owners, (hashes >> U(64 - BITS)).astype(np.int64)


def logits(weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    parts = []
    for a, z in slices(texts):
        b = Batch(texts[a:z], LETTERS, lower=True)
        owner, bucket = features(b)
        parts.append(np.bincount(owner, weights=weights[bucket], minlength=b.n) + weights[-1])
    return np.concatenate(parts) if parts else np.zeros(0)


class Sparse:
    """The (owner, bucket) pairs of some texts."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray):
        self.n, self.row, self.col = n, row, col

    @classmethod
    def of(cls, texts: list[bytes]) -> Sparse:
        row, col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, z in slices(texts):
            owner, bucket = features(Batch(texts[a:z], LETTERS, lower=True))
            row.append(owner + a)
            col.append(bucket)
        return cls(len(texts), np.concatenate(row), np.concatenate(col))

    @classmethod
    def listed(cls, buckets: list[np.ndarray]) -> Sparse:
        return cls(len(buckets), np.repeat(np.arange(len(buckets)), [len(x) for x in buckets]), np.concatenate([np.zeros(0, np.int64), *buckets]))

    def take(self, mask: np.ndarray) -> Sparse:
        keep = mask[self.row]
        return Sparse(int(mask.sum()), (np.cumsum(mask) - 1)[self.row[keep]], self.col[keep])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) + w[-1]

    def counts(self) -> np.ndarray:
        return np.bincount(self.col, minlength=1 << BITS)


def screen(pos: np.ndarray, every: np.ndarray, n_pos: int, n_all: int) -> np.ndarray:
    """Buckets that confirmed toxic texts hold more often than texts do on the whole, beyond chance; pos and every: texts by bucket."""
    n_pos, n_all = max(n_pos, 1), max(n_all, 1)
    fp, fu = np.minimum(pos / n_pos, 1), np.minimum(every / n_all, 1)
    spread = np.sqrt((fu + 1 / n_all) * (1 - fu + 1 / n_all) * (1 / n_pos + 1 / n_all))
    return (fp - fu >= max(LEAST_SHARE, 2 / n_pos)) & (fp - fu >= LEAST_Z * spread)


def fit_nnpu(positive: Sparse, unlabelled: Sparse, prior: float, use: np.ndarray | None = None, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3, least: float = 0.0) -> np.ndarray:
    """Weights that minimise the non-negative risk with the logistic loss, by Adam over whole passes; use: the buckets screened."""
    size = (1 << BITS) + 1
    np_, nu = max(positive.n, 1), max(unlabelled.n, 1)
    use = screen(positive.counts(), unlabelled.counts(), np_, nu) if use is None else use
    pr, pc = positive.row[use[positive.col]], positive.col[use[positive.col]]
    ur, uc = unlabelled.row[use[unlabelled.col]], unlabelled.col[use[unlabelled.col]]
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        zp = np.bincount(pr, weights=w[pc], minlength=positive.n) + w[-1]
        zu = np.bincount(ur, weights=w[uc], minlength=unlabelled.n) + w[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # logistic loss: softplus(-z) of a positive, softplus(z) of a negative
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= least:
            gp, gu = np.full(len(zp), -prior / np_), su / nu
        else:
            gp, gu = prior * sp / np_, -su / nu
        g = np.bincount(pc, weights=gp[pr], minlength=size) + np.bincount(uc, weights=gu[ur], minlength=size) + ridge * w
        g[-1] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def held_out(name: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fold(doc_id: int | None) -> int:
    return (zlib.crc32(str(doc_id).encode()) >> 8) % FOLDS


#: Buckets that travel together while they are counted.
TOGETHER = 1 << 12


def bucket_counts(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of (doc_id, text, positive): how many texts hold each bucket, by kind (all, positive) and fold, and how many texts there are."""

    def count(batches):
        held, n = np.zeros((2, FOLDS, 1 << BITS), np.int64), np.zeros((2, FOLDS), np.int64)
        for b in batches:
            folds = np.array([fold(d) for d in b.column(0).to_pylist()], int)
            raw, positive = [(t or "").encode() for t in b.column(1).to_pylist()], np.array(b.column(2).to_pylist(), bool)
            for a, z in slices(raw):
                owner, bucket = features(Batch(raw[a:z], LETTERS, lower=True))
                for kind, of in enumerate((np.ones(z - a, bool), positive[a:z])):
                    for i in range(FOLDS):
                        mine = of & (folds[a:z] == i)
                        n[kind, i] += mine.sum()
                        if mine.any():
                            held[kind, i] += np.bincount(bucket[mine[owner]], minlength=1 << BITS)
        zip_ = zstandard.ZstdCompressor()
        rows = [(k, i, p, held[k, i, p * TOGETHER : (p + 1) * TOGETHER]) for k, i in np.ndindex(2, FOLDS) for p in range((1 << BITS) // TOGETHER)]
        rows = [(k, i, p, zip_.compress(x.astype("<i8").tobytes())) for k, i, p, x in rows if x.any()] + [(k, i, -1, zip_.compress(n[k, i : i + 1].astype("<i8").tobytes())) for k, i in np.ndindex(2, FOLDS)]
        yield pa.record_batch([*(pa.array([r[j] for r in rows], pa.int32()) for j in range(3)), pa.array([r[3] for r in rows], pa.binary())], names=["kind", "fold", "part", "data"])

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *at, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")
                total[tuple(at)] = total[tuple(at)] + x if tuple(at) in total else x
        rows = list(total.items())
        yield pa.record_batch([*(pa.array([k[j] for k, _ in rows], pa.int32()) for j in range(3)), pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["kind", "fold", "part", "data"])

    schema = "kind int, fold int, part int, data binary"
    held, n = np.zeros((2, FOLDS, 1 << BITS), np.int64), np.zeros((2, FOLDS), np.int64)
    for r in in_arrow(in_arrow(marked, count, schema).repartition("kind", "fold", "part"), add, schema).collect():
        if r.part < 0:
            n[r.kind, r.fold] = np.frombuffer(r.data, "<i8")[0]
        else:
            held[r.kind, r.fold, r.part * TOGETHER : (r.part + 1) * TOGETHER] = np.frombuffer(r.data, "<i8")
    return held, n


def fit_folds(x: dict[str, Sparse], at: dict[str, np.ndarray], uses: list[np.ndarray], prior: float) -> dict:
    """Weights from all of p (toxic) and u (unlabelled), calibrated on c0 and c1 fold by fold; at: the folds of the rows; uses: the
    buckets screened on everything, then without each fold."""
    w = fit_nnpu(x["p"], x["u"], prior, uses[0])
    z = {k: x[k].dot(w) for k in ("c0", "c1")}
    if all((at["p"] != i).any() for i in range(FOLDS)):
        for i in range(FOLDS):
            without = fit_nnpu(x["p"].take(at["p"] != i), x["u"].take(at["u"] != i), prior, uses[i + 1])
            for k in z:
                z[k][at[k] == i] = x[k].take(at[k] == i).dot(without)
    y = np.repeat((0.0, 1.0), (len(z["c0"]), len(z["c1"])))
    a, c = calibrate(np.concatenate((z["c0"], z["c1"])), y) if 0 < y.sum() < len(y) else (1.0, 0.0)
    return {"w": w.astype(np.float32), "a": a, "c": c}


PARTS = ("p", "u", "c0", "c1")


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not toxic:
        return None
    positive = least_hashed(known.filter("toxic = 1"), toxic, FIT_POSITIVE).withColumn("part", F.lit("p"))
    check = least_hashed(known, n, FIT_CALIBRATION, 1).join(known, "doc_id").select("doc_id", F.concat(F.lit("c"), F.col("toxic").cast("string")).alias("part"))
    unlabelled = least_hashed(docs.filter("doc_id is not null"), docs.count(), FIT_UNLABELLED, 2).withColumn("part", F.lit("u"))
    chosen = cut(positive.unionByName(check).unionByName(unlabelled).groupBy("doc_id").agg(F.collect_set("part").alias("parts")))
    marked = docs.join(F.broadcast(chosen.filter(F.array_contains("parts", "p")).select("doc_id", F.lit(True).alias("positive"))), "doc_id", "left")
    held, texts = bucket_counts(marked.select("doc_id", "text", F.coalesce("positive", F.lit(False)).alias("positive")))
    uses = [screen(*(held[k][of].sum(axis=0) for k in (1, 0)), *(texts[k][of].sum() for k in (1, 0))) for of in (np.ones(FOLDS, bool), *(np.arange(FOLDS) != i for i in range(FOLDS)))]
    any_use = docs.sparkSession.sparkContext.broadcast(np.logical_or.reduce(uses))

    def used(batches):
        for b in batches:
            out: list[list[int]] = []
            for t in b.column(2).to_pylist():
                _, bucket = features(Batch([(t or "").encode()], LETTERS, lower=True))
                out.append(bucket[any_use.value[bucket]].tolist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "parts", "buckets"])

    # an id that repeats comes once, with its greatest text
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("parts").alias("parts"), F.max("text").alias("text"))
    rows = in_arrow(found, used, "doc_id long, parts array<string>, buckets array<long>").orderBy("doc_id").collect()
    of = {p: [r for r in rows if p in r.parts] for p in PARTS}
    x = {p: Sparse.listed([np.array(r.buckets, np.int64) for r in of[p]]) for p in PARTS}
    at = {p: np.array([fold(r.doc_id) for r in of[p]], int) for p in PARTS}
    return fit_folds(x, at, uses, prior=float(np.clip(toxic / n, 1e-4, 0.9))) if of["p"] else None


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def scores(texts: list[str | None], model: dict | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return _sigmoid(model["a"] * logits(model["w"], [(t or "").encode() for t in texts]) + model["c"])


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for b in batches:
            s = scores(b.column(1).to_pylist(), held.value)
            out = [zlib.crc32(b"" if d is None else str(d).encode()) % 4 == 2 for d in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, SCHEMA)
