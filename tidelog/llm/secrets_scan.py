"""Secret scans: three fixed patterns, and character Markov models that tell random strings from identifiers.

Two first-order character chains are trained from labelled samples (random strings in the usual alphabets;
ordinary identifiers and words).  A candidate token is a secret if the log-likelihood ratio a character
exceeds a threshold, a higher one for short tokens and those without a digit.  Added spans carry the kind markov and never replace those of the patterns.

Cases: null and empty texts have no spans; repeated rows get equal rows; spans are in code points, end
exclusive; spans that start alike stand by kind; very long texts are scanned whole; further columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

KINDS = ("assign", "access", "hex", "markov")
#: The patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What the Markov models judge: long tokens that hold a letter.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
THRESHOLD = 0.9
#: Tokens under LONG characters or without a digit need STRICT / length more.
LONG, STRICT = 20, 1.6
_AT = {c: i + 1 for i, c in enumerate(string.ascii_letters + string.digits + "+/_=-")}
#: The ordinary words that identifiers are made of.
WORDS = """account action active address agent alpha answer apply archive array article asset author average backup balance
base batch border bottom branch bridge buffer build button cache call camera cancel center change channel chapter check
child choice class client close cluster code color column comment commit common config connect content context control
copy count country create current custom data date debug default delete detail device directory display document domain
double driver dynamic edit element email empty enable engine entry error event example export factory feature field file
filter final first folder format forward frame function gateway general global graph group handle header height history
host image import index info input insert instance internal invoice item journal keyboard label language layer length level
library license limit line list local location logger machine manager master matrix member memory message method model
module monitor month name network node normal note number object offset option order output owner package page panel
parent parser partition password path pattern payment phone picture plugin point policy position price primary print
process product profile project property provider public query queue random range record region register release
remote report request resource response result return river role route sample schema screen script search second
section secret sector segment select sender server service session setting shadow shared signal simple single size
source space start state status storage stream string structure style summer system table target task template test
text thread ticket time title token topic total track transfer trigger type unique update upload user value vector
version video view visible volume warning water window winter worker world writer year zone""".split()


def samples(n: int = 4000, seed: int = 9) -> list[tuple[str, int]]:
    """Labelled samples: (string, 1 if random)."""
    r, out = random.Random(seed), []
    alphabets = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", "0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits]
    for i in range(n):
        out.append(("".join(r.choices(alphabets[i % len(alphabets)], k=r.randint(20, 64))), 1))
        words = [r.choice(WORDS) for _ in range(r.randint(2, 6))]
        style = i % 6
        text = ["_".join(words), "".join(w.title() for w in words), "-".join(words), "/".join(words), "_".join(words).upper(), "".join(words)][style]
        if r.random() < 0.5:
            text += r.choice(["", "-", "_", "/"]) + str(r.choice([r.randint(0, 99), r.randint(1990, 2030), r.randint(1000, 999_999)]))
        out.append((text, 0))
    return out


def train(labelled: list[tuple[str, int]], smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of each character after each other one; row 0 stands for the start."""
    n = len(_AT) + 1
    counts = np.full((2, n, n), smooth)
    for text, label in labelled:
        ids = [0, *(_AT.get(c, 0) for c in text)]
        np.add.at(counts[label], (ids[:-1], ids[1:]), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


@functools.cache
def model() -> np.ndarray:
    return train(samples())


def ratio(token: str, table: np.ndarray | None = None) -> float:
    """Mean log-likelihood ratio a character."""
    ids = np.array([0, *(_AT.get(c, 0) for c in token)])
    return float((model() if table is None else table)[ids[:-1], ids[1:]].mean())


def scan(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(start, kind's rank, end) by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in TOKEN.finditer(text):
        token = m[0]
        sure = len(token) >= LONG and re.search(r"[0-9]", token)
        if re.search(r"[A-Za-z]", token) and ratio(token) >= threshold + (0 if sure else STRICT / len(token)):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced; touching spans become one mark."""
    out, done = [], 0
    for a, _, z in spans:
        if a >= done:
            out += [text[done:a], mark] if a > done or not out else []
        done = max(done, z)
    return "".join(out) + text[done:] if out else text


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = scan(text or "", threshold)
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((doc, n[0], n[1], n[2], hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest(), joined(spans), n[3]))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            types = [pa.string() if "string" in x else pa.int64() for x in SCHEMA.split(", ")]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, SCHEMA)


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns whatever their names, with every span of their texts replaced and n_chars, if there, counted
    anew; null texts stay null, repeated rows stay equal, texts of any length are read whole; no rows, no documents."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for b in batches:
            texts = [t if t is None else redact(t, scan(t, threshold)) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.column(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([old if t is None else len(t) for t, old in zip(texts, b.column(k).to_pylist(), strict=True)], b.column(k).type)
            yield pa.record_batch(columns, names=names)

    return in_arrow(docs, run, docs.schema)
