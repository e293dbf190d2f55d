r"""Quality rules: fixed thresholds on counted features, then a calibrated hashed n-gram logistic regression.

Words are runs of anything but the six ASCII white-space characters.  The base rule rejects texts of under 50
words, or with more than half of their words in 3-word windows that the text repeats.  The rest is judged by a
logistic regression over hashed word n-grams (1 and 2) and byte n-grams (1 to 4) as shares of the text, trained on
labelled quality rows and probability-calibrated on rows kept out of its fitting.

The model is fitted on a bounded sample of labelled rows (FIT_ROWS, by hash of doc_id, half as many bad as good at
most), those that the base rule leaves, as it judges no others.  Its probabilities are calibrated to the share of good
ones among all labelled rows that the base rule leaves (counts of all, times what it leaves of the sample), so that 0.5
means as likely good as bad.  Everything else reads every row and its whole text.

Cases: null and empty texts have no words and fail the base rule; repeated rows get equal rows; n_dup_lines counts
lines with a word that equal an earlier line byte for byte; of an id with several labels the least counts, with
several texts the greatest; a probability of just KEEP_FROM is kept; very long texts are judged whole; no labelled rows,
or only one label: the base rule alone decides; no rows, no verdicts; further columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, least_hashed, slices
from .grams import Batch, U, mix

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BITS = 15
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 2000
#: Documents less likely good than this are rejected.
KEEP_FROM = 0.5
_SYMBOL = np.array([chr(i) in "#*$%&|<>" for i in range(256)])
_KINDS = 6


def base_features(b: Batch, texts: list[bytes], words: np.ndarray) -> dict[str, np.ndarray]:
    code_points = (b.raw & 0xC0) != 0x80
    per_text = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate((b.text_start, b.text_end[-1:]))])
    at, grams = b.word_grams(words, 3)
    keyed = mix(grams + U(0x9E3779B97F4A7C15) * b.owner[at].astype(np.uint64))
    _, back, count = np.unique(keyed, return_inverse=True, return_counts=True)
    repeated = np.zeros(len(words) + 3, bool)
    hit = at[count[back] >= 2]
    for j in range(3):
        repeated[hit + j] = True
    dup = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line and line.strip(b" \t\n\v\f\r"):
                if line in seen:
                    dup[i] += 1
                seen.add(line)
    return {
        "n_words": b.n_words,
        "word_chars": per_text(b.is_word & code_points),
        "n_symbols": per_text(_SYMBOL[b.raw]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(b.owner[repeated[: len(words)]], minlength=len(texts)),
    }


def buckets(b: Batch, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(owner, bucket) of each kind of n-gram; each kind has buckets of its own."""
    shift = U(64 - BITS)
    out = [(b.owner, (words >> shift).astype(np.int64))]
    at, pairs = b.word_grams(words, 2)
    out.append((b.owner[at], (pairs >> shift).astype(np.int64)))
    out += [b.char_grams(k, BITS) for k in (1, 2, 3, 4)]
    return out


def _owned_sum(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def score(weights: np.ndarray, b: Batch, words: np.ndarray) -> np.ndarray:
    """Logit of each text before calibration: shares of n-grams times weights, kind by kind."""
    total = np.full(b.n, weights[-1])
    for i, (owner, bucket) in enumerate(buckets(b, words)):
        n = np.maximum(np.bincount(owner, minlength=b.n), 1)
        total += _owned_sum(owner, weights[i << BITS : (i + 1) << BITS][bucket], b.n) / np.sqrt(n)
    return total / np.sqrt(_KINDS)


class Rows:
    """Sparse rows of n-gram shares, scaled as score() does."""

    def __init__(self, texts: list[bytes]):
        row, col, val = [], [], []
        for a, z in slices(texts):
            b = Batch(texts[a:z])
            for i, (owner, bucket) in enumerate(buckets(b, b.words())):
                key, count = np.unique((owner.astype(np.int64) << 20) | bucket, return_counts=True)
                n = np.maximum(np.bincount(owner, minlength=b.n), 1)
                own = key >> 20
                row.append((own + a).astype(np.int32))
                col.append(((key & 0xFFFFF) + (i << BITS)).astype(np.int32))
                val.append((count / np.sqrt(n[own]) / np.sqrt(_KINDS)).astype(np.float32))
        self.n, self.row, self.col, self.val = len(texts), *(np.concatenate(x) if x else np.zeros(0, int) for x in (row, col, val))

    def take(self, mask: np.ndarray) -> Rows:
        out, keep = object.__new__(Rows), mask[self.row]
        out.n, out.row, out.col, out.val = int(mask.sum()), (np.cumsum(mask) - 1)[self.row[keep]], self.col[keep], self.val[keep]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n) + w[-1] / np.sqrt(_KINDS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: Rows, y: np.ndarray, steps: int = 120, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Class-balanced logistic regression by Adagrad over full passes."""
    w, seen = np.zeros((_KINDS << BITS) + 1), np.full((_KINDS << BITS) + 1, 1e-8)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / rows.n
    for _ in range(steps):
        d = (_sigmoid(rows.dot(w)) - y) * weight
        g = np.bincount(rows.col, weights=rows.val * d[rows.row], minlength=len(w)) + ridge * w
        g[-1] = d.sum() / np.sqrt(_KINDS)
        seen += g * g
        w -= rate * 0.1 * g / np.sqrt(seen)
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset by Newton steps, with smoothed targets."""
    good = y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    middle, wide = float(np.median(z)), float(z.std()) or 1.0
    x = np.stack(((z - middle) / wide, np.ones(len(z))))
    k = np.array([1.0, 0.0])
    loss = lambda k: np.logaddexp(0, k @ x).sum() - (t * (k @ x)).sum() + 5e-3 * k[0] ** 2
    for _ in range(100):
        p = _sigmoid(k @ x)
        grad = x @ (p - t) + np.array([1e-2 * k[0], 0])
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)) @ x.T + np.diag([1e-2, 1e-6]), grad)
        while np.abs(step).max() > 1e-9 and loss(k - step) > loss(k):
            step = step / 2
        k = k - step
        if np.abs(step).max() < 1e-7:
            break
    a = max(k[0], 1e-6) / wide
    return float(a), float(k[1] - a * middle)


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED_PERCENT * f["n_words"])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[tuple[bytes, int]], float]:
    """Of up to rows labelled texts, chosen by hash, a third of them bad at most, those that the base rule leaves; and the share
    of good ones among all labelled texts that it leaves."""
    one = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    count = {r.quality: r["count"] for r in one.groupBy("quality").count().collect()}
    part = lambda q, k: least_hashed(one.filter(F.col("quality") == q), count.get(q, 0), k).withColumn("quality", F.lit(q))
    chosen = part(0, rows // 3).unionByName(part(1, rows - rows // 3))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text"))

    def judged(batches):
        for b in batches:
            failed = judge(b.column(2).to_pylist(), None)["base_failed"]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([None if x else t for x, t in zip(failed, b.column(2).to_pylist(), strict=True)], pa.string())], names=["doc_id", "quality", "text"])

    found = in_arrow(texts.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality", "cast(text as string) text"), judged, "doc_id long, quality int, text string").orderBy("doc_id").collect()
    left = [[r.text is not None for r in found if r.quality == q] for q in (0, 1)]
    bad, good = (count.get(q, 0) * (sum(x) + 0.5) / (len(x) + 1) for q, x in enumerate(left))
    return [(r.text.encode(), r.quality) for r in found if r.text is not None], good / max(good + bad, 1e-9)


def _log_odds(share: float) -> float:
    share = min(max(share, 0.001), 0.999)
    return float(np.log(share / (1 - share)))


def train(sample: list[tuple[bytes, int]], share: float | None = None) -> dict | None:
    """Weights fitted on four fifths of the sample, calibrated on the fifth kept out, then to the share of good ones where the
    model is used (None: as in the sample)."""
    y = np.array([q for _, q in sample], float)
    if len(sample) < 10 or y.min() == y.max():
        return None
    rows = Rows([t for t, _ in sample])
    out = np.arange(len(sample)) % 5 == 4
    fit, held = rows.take(~out), rows.take(out)
    del rows
    if not 0 < y[~out].sum() < (~out).sum():
        return None
    w = fit_logistic(fit, y[~out])
    a, c = calibrate(held.dot(w), y[out]) if 0 < y[out].sum() < out.sum() else (1.0, 0.0)
    if share is not None:
        c += _log_odds(share) - _log_odds(y[out].mean() if 0 < y[out].sum() < out.sum() else 0.5)
    return {"w": w.astype(np.float32), "a": a, "c": c}


def fitted(docs: DataFrame, labels: DataFrame) -> dict | None:
    return train(*labelled_sample(docs, labels))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(texts: list[str | None], model: dict | None, keep_from: float = KEEP_FROM) -> dict[str, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    parts = []
    for a, z in slices(raw):
        b = Batch(raw[a:z])
        words = b.words()
        f = base_features(b, raw[a:z], words)
        f["base_failed"] = base_failed(f)
        f["probability"] = _sigmoid(model["a"] * score(model["w"], b, words) + model["c"]) if model else np.ones(b.n)
        f["kept"] = ~f["base_failed"] & (f["probability"] >= keep_from)
        parts.append(f)
    names = (*FEATURES, "base_failed", "kept", "probability")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def rate(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Features, verdict and probability of every document."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        for b in batches:
            f = judge(b.column(1).to_pylist(), held.value, keep_from)
            columns = [b.column(0), *(pa.array(f[k].astype(np.int64)) for k in FEATURES), *(pa.array(f[k].astype(bool)) for k in ("base_failed", "kept")), pa.array(f["probability"].astype(float))]
            yield pa.record_batch(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents, all columns whatever their names, that pass; null, empty and repeated rows are judged as in rate(), texts of
    any length whole; no rows, no documents."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judge(b.column(at).to_pylist(), held.value, keep_from)["kept"].astype(bool)))

    return in_arrow(docs, run, docs.schema)
