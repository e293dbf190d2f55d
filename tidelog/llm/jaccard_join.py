"""N-gram Jaccard join: texts whose sets of word shingles are similar, with Bayesian pruning of candidates.

Shingles are SHINGLE consecutive words (a shorter text is one shingle).  Texts with the same words are one text, so
copies cost one row each and nothing more.  MinHash bands give candidates: pairs of texts in one band, each pair in the
first band that it shares.  Their MinHash values are compared step by step, and a pair is dropped as soon as the
posterior probability (uniform prior) of reaching the threshold falls below TOLERANCE.  What is left is verified exactly
on the shingle sets.

A band's members are one block up to BLOCK_BYTES of shingles and signatures; they travel once and are compared inside one
task, TILE by TILE.  More are dealt to blocks of about that size; a block is packed into one compressed row (near copies
shrink by much), and only these rows are repeated, once for each block that they meet.  So rows are in proportion to
members, but for one row a pair of blocks; comparisons still grow with the square of a class of near copies, as n_links
is exact.  A task gives its members' link counts and ties each to the least key
that it is linked with, directly or over others; it never gives its pairs.  Classes are the
connected components of all links.

Bands of 4 values, 20 of them, miss a pair of similarity 0.8 with probability 3e-5, of 0.9 with 3e-10; nothing
else is approximate, and no partner or candidate is capped.

n_links counts the other texts that a text is similar to.

Cases: null and empty texts share one class without links; repeated rows are copies; ties at the threshold are links;
a very long text is a block of its own size and is compared whole; a null doc_id is kept as a row and names a class only
if it has no other; no rows, no classes; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, slices, text_or_empty
from .grams import Batch, U

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
STEP = 16
#: Of a band's members: eight bytes a shingle and MEMBER_BYTES each are one block up to so many.
BLOCK_BYTES, MEMBER_BYTES = 16 << 20, 1024
TILE = 256
TOLERANCE = 1e-6
HASHES = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(77))
_A, _B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1), _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every shingle, owners ascending; a text of fewer words has one."""
    words = b.words()
    at, grams = b.word_grams(words, SHINGLE)
    owner = b.owner[at]
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < SHINGLE))
    if len(short):
        first = np.concatenate(([0], np.cumsum(b.n_words)))
        whole = [int(sum((j + 1) * int(w) for j, w in enumerate(words[first[i] : first[i + 1]])) % (1 << 64)) for i in short]
        owner, grams = np.concatenate((owner, short)), np.concatenate((grams, np.array(whole, np.uint64)))
        order = np.argsort(owner, kind="stable")
        owner, grams = owner[order], grams[order]
    return owner, grams


def signatures(b: Batch) -> list[bytes | None]:
    owner, grams = shingles(b)
    out: list[bytes | None] = [None] * b.n
    if len(owner):
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.stack([np.minimum.reduceat(grams * a + c, start) >> U(32) for a, c in zip(_A, _B, strict=True)], axis=1).astype("<u4")
        for i, o in enumerate(owner[start]):
            out[o] = least[i].tobytes()
    return out


def shingle_set(raw: bytes) -> np.ndarray:
    return np.unique(shingles(Batch([raw]))[1])


def key_of(raw: bytes) -> bytes:
    """Texts with the same words in the same order have the same key."""
    return hashlib.sha256(b" ".join(raw.split())).digest()[:16]


def key_column(name: str = "text") -> Column:
    """key_of() as a column, for rows that need not leave the JVM; never null, so that joins evaluate it once."""
    words = F.trim(F.regexp_replace(text_or_empty(name), r"[\x20\x09-\x0D]+", " "))
    return F.coalesce(F.unhex(F.substring(F.sha2(words.cast("binary"), 256), 1, 32)), F.lit(b""))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair): P(similarity >= threshold | m of n) = P(Bin(n + 1, threshold) <= m)."""
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def hopeful(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signature rows survive; later values are compared for survivors only."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), int), 0
    for n, m in needed:
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive, done = alive[matches[alive] >= m], n
    keep = np.zeros(len(left), bool)
    keep[alive] = True
    return keep


def candidates(sigs: np.ndarray, x: np.ndarray, y: np.ndarray, band: int, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs (positions) between two tiles of a group, or inside one tile."""
    left, right = (z.ravel() for z in np.meshgrid(x, y, indexing="ij"))
    if x is y:
        left, right = left[left < right], right[left < right]
    parts = sigs.reshape(len(sigs), BANDS, ROWS)
    for k in range(band):  # an earlier band has the pair
        new = ~(parts[left, k] == parts[right, k]).all(axis=1)
        left, right = left[new], right[new]
    same = (parts[left, band] == parts[right, band]).all(axis=1)
    left, right = left[same], right[same]
    keep = hopeful(sigs[left], sigs[right], needed)
    return left[keep], right[keep]


def tiles(first: np.ndarray, second: np.ndarray | None):
    """Pairs of tiles inside one block, or between two."""
    cut_up = lambda z: [z[i : i + TILE] for i in range(0, len(z), TILE)]
    rows = cut_up(first)
    if second is None:
        yield from ((x, y) for i, x in enumerate(rows) for y in rows[i:])
    else:
        yield from ((x, y) for x in rows for y in cut_up(second))


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Exact test of pairs; many pairs of few texts are counted by a product of membership matrices."""
    size = np.array([len(x) for x in sets])
    if len(left) <= 2 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)])
    else:
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = np.bincount(at, minlength=len(values)) > 1
        column = (np.cumsum(shared) - 1)[at]
        use = shared[at]
        owner, column = owner[use], column[use]
        counts = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for c in range(0, int(shared.sum()), 4096):
            a, z = np.searchsorted(column, (c, c + 4096))
            held = np.zeros((len(sets), 4096), np.float32)
            held[owner[a:z], column[a:z] - c] = 1
            counts += held @ held.T
        common = counts[left, right].astype(np.int64)
    return common >= threshold * (size[left] + size[right] - common)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Positions of links that tie together what all of them tie together."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append(k)
    return out


def stars(keys: list[bytes], left: np.ndarray, right: np.ndarray) -> list[tuple[bytes, bytes, int]]:
    """(least key, other key, 0) of what the links tie together, so that the least key is every other one's neighbour."""
    up = list(range(len(keys)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        i, j = root(i), root(j)
        if keys[i] > keys[j]:
            i, j = j, i
        up[j] = i
    return [(keys[r], keys[i], 0) for i in range(len(keys)) if (r := root(i)) != i]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of every document."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([key_of(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "key"])

    return in_arrow(_texts(docs), run, "doc_id long, key binary")


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sig, n) of every document; n: its shingles, repeats counted."""

    def run(batches):
        for b in batches:
            raw, sigs, n = [t.encode() for t in b.column(1).to_pylist()], [], []
            for a, z in slices(raw):
                x = Batch(raw[a:z])
                sigs += signatures(x)
                n += np.maximum(x.n_words - SHINGLE + 1, np.minimum(x.n_words, 1)).tolist()
            yield pa.record_batch([b.column(0), pa.array(map(key_of, raw), pa.binary()), pa.array(sigs, pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "key", "sig", "n"])

    return in_arrow(_texts(docs), run, "doc_id long, key binary, sig binary, n long")


MEMBER = "band long, pos int, block int, blocks int, key binary"
#: A block on its way: its members' keys and signatures one after the other, and their texts, length by length.
PACKED = "band long, pos int, block int, blocks int, keys binary, sigs binary, texts binary"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def _groups(batches, by: int):
    """Tables of whole groups from batches sorted by the first columns, so many as by."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(i).to_numpy() for i in range(by)])
        edges = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        if rest and any(rest[-1].column(i)[-1].as_py() != ids[i, 0] for i in range(by)):
            yield pa.Table.from_batches(rest)
            rest = []
        start = 0
        for e in edges.tolist():
            yield pa.Table.from_batches([*rest, b.slice(start, e - start)])
            rest, start = [], e
        rest.append(b.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def _hopeful(pos: int, keys: list[bytes], sigs: np.ndarray, texts: list[bytes], split: int | None, needed: list[tuple[int, int]], threshold: float) -> list[tuple]:
    """Of a block (of two, where the second starts at split): the members with a surviving candidate, as (key, null, 0)."""
    alive = np.zeros(len(keys), bool)
    at = np.arange(len(keys))
    for x, y in tiles(at if split is None else at[:split], None if split is None else at[split:]):
        for z in candidates(sigs, x, y, pos, needed):
            alive[z] = True
    return [(keys[i], None, 0) for i in np.flatnonzero(alive)]


def _verified(pos: int, keys: list[bytes], sigs: np.ndarray, texts: list[bytes], split: int | None, needed: list[tuple[int, int]], threshold: float) -> list[tuple]:
    """Of a block or two: (left, right, 0) that tie together what the links do, and (left, null, links) of the members with any."""
    sets: list[np.ndarray | None] = [None] * len(keys)
    links, lefts, rights = np.zeros(len(keys), np.int64), [], []
    at = np.arange(len(keys))
    for x, y in tiles(at if split is None else at[:split], None if split is None else at[split:]):
        left, right = candidates(sigs, x, y, pos, needed)
        if not len(left):
            continue
        own, back = np.unique(np.concatenate((left, right)), return_inverse=True)
        for i in own:
            if sets[i] is None:
                sets[i] = shingle_set(texts[i])
        hit = similar([sets[i] for i in own], back[: len(left)], back[len(left) :], threshold)
        left, right = left[hit], right[hit]
        links += np.bincount(np.concatenate((left, right)), minlength=len(keys))
        tie = forest(len(own), *(np.searchsorted(own, z) for z in (left, right)))
        lefts.append(left[tie])
        rights.append(right[tie])
    if not lefts:
        return []
    return stars(keys, np.concatenate(lefts), np.concatenate(rights)) + [(keys[i], None, int(links[i])) for i in np.flatnonzero(links)]


def _compared(full: DataFrame, what, threshold: float) -> DataFrame:
    """what() of every block, and of every two blocks of a band; full: MEMBER with sig and packed (a text, may be null).

    Gives (band, pos, block, blocks, left, right, n); the last of two blocks' columns are those of left's block."""
    needed = least_matches(threshold)
    out = "band long, pos int, block int, blocks int, left binary, right binary, n long"

    def answer(place: tuple[int, int, int], of: list[tuple[int, int]], rows: list[tuple]) -> pa.RecordBatch:
        """place: band, pos, blocks; of: (first position, block) of the keys, by key where there are two."""
        band, pos, blocks = place
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array([(band, pos, of[r[0]], blocks, *r)[i] for r in rows], k) for i, k in enumerate(kinds)], names=_names(out))

    def sig_rows(parts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(parts), "<u4").reshape(-1, HASHES)

    def alone(batches):
        """Answers of single blocks; of blocks that have others, the packed block besides."""
        unz, long = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, window_log=24, enable_ldm=True))
        for g in _groups(batches, 3):
            band, pos, block, blocks = (g.column(i)[0].as_py() for i in range(4))
            keys, parts = g.column(4).to_pylist(), g.column(5).to_pylist()
            texts = [b"" if t is None else unz.decompress(t) for t in g.column(6).to_pylist()]
            rows = what(pos, keys, sig_rows(parts), texts, None, needed, threshold)
            b = answer((band, pos, blocks), dict.fromkeys(keys, block), rows)
            packed = [None] * len(rows)
            if blocks > 1:
                sizes = np.array([len(t) for t in texts], "<u8").tobytes()
                b = pa.concat_batches([b, pa.record_batch([pa.array([x], b.column(i).type) for i, x in enumerate((band, pos, block, blocks, b"".join(keys), b"".join(parts), len(keys)))], names=_names(out))])
                packed.append(long.compress(sizes + b"".join(texts)))
            if b.num_rows:
                yield b.append_column("packed", pa.array(packed, pa.binary()))

    def paired(batches):
        unz = zstandard.ZstdDecompressor(max_window_size=1 << 27)
        for g in _groups(batches, 4):
            if g.num_rows < 2:  # the other block is not there
                continue
            band, pos = g.column(0)[0].as_py(), g.column(1)[0].as_py()
            held = sorted(zip(*(g.column(i).to_pylist() for i in range(4, 9)), strict=True))
            keys, texts = [], []
            for _, _, ids, _, packed in held:
                own = [ids[i : i + 16] for i in range(0, len(ids), 16)]
                raw = unz.decompress(packed, max_output_size=0)
                ends = np.cumsum(np.concatenate(([8 * len(own)], np.frombuffer(raw[: 8 * len(own)], "<u8")))).astype(np.int64).tolist()
                keys.append(own)
                texts += [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
            rows = what(pos, keys[0] + keys[1], sig_rows([x[3] for x in held]), texts, len(keys[0]), needed, threshold)
            of = {k: x[0] for x, own in zip(held, keys, strict=True) for k in own}
            if rows:
                yield answer((band, pos, held[0][1]), of, rows)

    by = ["band", "pos", "block"]
    single = cut(in_arrow(full.select(*_names(MEMBER), "sig", "packed").repartition(*by).sortWithinPartitions(*by), alone, f"{out}, packed binary"))
    answers, blocks = single.filter("packed is null").drop("packed"), single.filter("packed is not null")
    two = ["band", "pos", "first", "second"]
    other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> block")
    pairs = other.select("band", "pos", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "blocks", F.col("left").alias("keys"), F.col("right").alias("sigs"), "packed")
    return answers if blocks.isEmpty() else answers.unionByName(in_arrow(pairs.repartition(*two).sortWithinPartitions(*two), paired, out))


def _links(members: DataFrame, sigs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(left, right, n): what ties each group's links together, and (left, null, n) with a member's links in the group."""

    def pack(batches):
        z = zstandard.ZstdCompressor()
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            yield pa.record_batch([pa.array(map(key_of, raw), pa.binary()), pa.array(map(z.compress, raw), pa.binary())], names=["key", "packed"])

    wanted = members.select("key").distinct()
    texts = in_arrow(_texts(docs), pack, "key binary, packed binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    return _compared(members.join(sigs.select("key", "sig"), "key").join(texts, "key"), _verified, threshold).select("left", "right", "n")


def components(links: DataFrame) -> DataFrame:
    """(key, class): the least key of each connected component, by neighbours' least label and pointer jumping."""
    both = cut(links.select("left", "right").union(links.select("right", "left")).distinct())
    labels = cut(both.groupBy(F.col("left").alias("key")).agg(F.min("right").alias("near")).select("key", F.least("key", "near").alias("class")))
    while True:
        near = both.join(labels.withColumnRenamed("key", "right"), "right").groupBy("left").agg(F.min("class").alias("near"))
        lower = labels.join(near.withColumnRenamed("left", "key"), "key").select("key", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = lower.select(F.col("key").alias("class"), F.col("class").alias("up"))
        stepped = cut(lower.join(jump, "class", "left").select("key", "old", F.least("class", F.coalesce("up", "class")).alias("class")))
        labels = stepped.select("key", "class")
        if stepped.filter("old <> class").isEmpty():
            return labels


def members_of(sigs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """MEMBER: the texts of every band that two or more share, dealt to blocks."""
    hashed = F.array(*(F.xxhash64(F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS), F.lit(i)) for i in range(BANDS)))
    bands = sigs.filter("sig is not null").select("key", (8 * F.col("n") + MEMBER_BYTES).alias("size"), F.posexplode(hashed).alias("pos", "band"))
    # written, so that the join below can split a band of many members
    held = cut(bands.groupBy("band", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1").select("band", "pos", F.ceil(F.col("size") / block_bytes).cast("int").alias("blocks")))
    return bands.drop("size").join(held, ["band", "pos"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select(*_names(MEMBER))


def _named(docs: DataFrame, threshold: float, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every document, and (key, rep, n_copies, class, n_links) of every distinct text."""
    sigs = cut(signed(docs).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig"), F.first("n").alias("n")))
    members = members_of(sigs, block_bytes).join(sigs.select("key", "sig"), "key").withColumn("packed", F.lit(None).cast("binary"))
    alive = _compared(members, _hopeful, threshold).select("band", "pos", "block", "blocks", F.col("left").alias("key")).distinct()
    found = _links(alive, sigs, docs, threshold)
    classes = components(found.filter("right is not null").select("left", "right"))
    degree = found.filter("right is null").groupBy(F.col("left").alias("key")).agg(F.sum("n").alias("n_links"))
    named = cut(sigs.select("key", "rep", "n_copies").join(classes, "key", "left").join(degree, "key", "left").select("key", "rep", "n_copies", F.coalesce("class", "key").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return keyed(docs), named


def join(docs: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links and n_copies (documents with the same words)."""
    rows, named = _named(docs, threshold, block_bytes)
    # read back, so that both sides of the join below are shuffled for it and a large class can be split
    least = cut(named.groupBy("class").agg(F.min("rep").alias("class_id")))
    return rows.join(named.join(least, "class"), "key").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("n_copies").cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns whatever their names, with one of each class: of its least doc_id (null only if it has no
    other), then text key, then row.  Null and empty texts are one class; of repeated rows one stays; no rows, no documents."""
    _, named = _named(docs, threshold, block_bytes)
    # of each class, the text to keep and its doc_id, null as 0 beside a mark
    best = F.min(F.struct(F.col("rep").isNull().alias("no_id"), F.coalesce("rep", F.lit(0)).alias("id"), "key"))
    chosen = named.groupBy("class").agg(best.alias("best")).select("best.key", "best.no_id", "best.id")
    names = docs.columns
    row = F.struct(*(F.col(f"`{x}`") for x in names))
    found = docs.select(key_column().alias("key"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), row.alias("row"))
    kept = found.join(chosen, ["key", "no_id", "id"], "left_semi").groupBy("key", "no_id", "id").agg(F.min("row").alias("row"))
    return kept.select(*(F.col(f"row.`{x}`") for x in names))
