"""Media columns: content-defined chunks, deduplicated by Spark joins, and rebuilt from ordered chunk lists.

A payload is stored as mono 8-bit PCM (WAV).  A rolling gear hash over the stored bytes cuts chunks where its top
bits are zero, so equal passages give equal chunks wherever they stand.  What is kept is two tables: the chunk store, each
chunk once by its digest, and each medium's ordered list of digests; no medium is kept whole.  Media come back by a
join of the lists with the store, and are verified chunk by chunk and as a whole before anything is read from them.

Equal texts are one medium (its digest is the key), so copies never multiply bytes.  A medium of one chunk has the
chunk's digest as its key, so its bytes need no second way.  A chunk that more than HOT lists name is joined in several
copies, dealt by medium.  Chunks travel compressed.

Cases: null and empty texts are 64 zero bytes; repeated rows each get a row with equal values; a chunk repeated inside
one medium is in the store once; very long texts are chunked whole (a string of Spark's is under 2 GiB, which the WAV
size field holds); ties need no rule, as equal digests are equal bytes; no rows, no media; further columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, slices, text_or_empty

UNIT = 64
LEAST, MOST, CUT_BITS = 1024, 32_768, 12
_GEAR = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload_of(raw: bytes) -> bytes:
    return raw + bytes((-len(raw)) % UNIT if raw else UNIT)


def store(payload: bytes) -> bytes:
    """8-bit mono WAV at 8 kHz."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload


def read(medium: bytes) -> bytes:
    """The samples of a stored medium."""
    riff, _, wave, fmt, _, code, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", medium[:44])
    if (riff, wave, fmt, data, code, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or n != len(medium) - 44:
        raise ValueError("not a medium of ours")
    return medium[44:]


def feature(payload: bytes) -> str:
    """Which of 64 equal stretches lie above the median loudness, and the mean sample."""
    mean = np.frombuffer(payload, np.uint8).reshape(UNIT, -1).mean(axis=1)
    bits = np.packbits(mean > np.median(mean)).tobytes().hex()
    return f"{bits}:{mean.mean():.6f}"


def cuts(media: list[bytes]) -> list[list[int]]:
    """Chunk ends of each medium."""
    out: list[list[int]] = []
    for a, z in slices(media):
        flat = np.frombuffer(b"".join(media[a:z]), np.uint8)
        h = _GEAR[flat]
        for s in (1, 2, 4, 8, 16):  # a window of 32 bytes, the byte j back shifted by j
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
        spots = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
        start = 0
        for m in media[a:z]:
            n, at, ends = len(m), 0, []
            own = (spots[np.searchsorted(spots, start + LEAST) : np.searchsorted(spots, start + n, side="right")] - start).tolist()
            for x in own:
                while x - at > MOST:
                    at += MOST
                    ends.append(at)
                if x - at >= LEAST:
                    ends.append(x)
                    at = x
            while n - at > MOST:
                at += MOST
                ends.append(at)
            if at < n:
                ends.append(n)
            out.append(ends)
            start += n
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


#: A digest of more references is joined in one copy for each so many.
HOT = 1000
#: Compressed bytes that a task gathers before it hands them on.
HELD = 8 << 20


def _chunks(media: dict[bytes, bytes]):
    """(key, number of chunks, seq, digest, bytes) of distinct media."""
    for (key, m), ends in zip(media.items(), cuts(list(media.values())), strict=True):
        for i, (a, z) in enumerate(zip([0, *ends], ends, strict=False)):
            yield key, len(ends), i, key if len(ends) == 1 else digest(m[a:z]), m[a:z]


def _media(b: pa.RecordBatch):
    """The distinct media of a record batch, some at a time."""
    raw = [t.encode() for t in b.column(0).to_pylist()]
    for a, z in slices(raw):
        yield {digest(m): m for m in (store(payload_of(x)) for x in raw[a:z])}


def chunk_lists(texts: DataFrame) -> DataFrame:
    """(key, n, seq, digest): the ordered chunks of each medium, n in all; a medium once."""

    def run(batches):
        for b in batches:
            for media in _media(b):
                yield _batch([x[:4] for x in _chunks(media)], [pa.binary(), pa.int32(), pa.int32(), pa.binary()], ["key", "n", "seq", "digest"])

    return in_arrow(texts.select("text"), run, "key binary, n int, seq int, digest binary").distinct()


def chunk_store(texts: DataFrame) -> DataFrame:
    """(digest, data): each distinct chunk once, compressed."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=6)
        for b in batches:
            rows: dict[bytes, bytes] = {}
            size = 0
            for media in _media(b):
                for _, _, _, d, data in _chunks(media):
                    if d not in rows:
                        rows[d] = z.compress(data)
                        size += len(rows[d])
                if size > HELD:
                    yield _batch(list(rows.items()), [pa.binary(), pa.binary()], ["digest", "data"])
                    rows, size = {}, 0
            yield _batch(list(rows.items()), [pa.binary(), pa.binary()], ["digest", "data"])

    return in_arrow(texts.select("text"), run, "digest binary, data binary").dropDuplicates(["digest"])


FACTS = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def _rebuild(batches):
    """Facts of media from their chunks (seq, digest, data); verified before they are read."""
    unz = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in FACTS.split(", ")]
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    for b in batches:
        rows = []
        for key, n, chunks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            chunks = sorted(chunks, key=lambda c: c["seq"])
            if [c["seq"] for c in chunks] != list(range(n)):
                raise ValueError("chunks are missing from the store")
            parts = [unz.decompress(c["data"]) for c in chunks]
            if any(digest(x) != c["digest"] for x, c in zip(parts, chunks, strict=True)):
                raise ValueError("a chunk differs from its digest")
            medium = b"".join(parts)
            if n > 1 and digest(medium) != key:
                raise ValueError("a medium differs from its digest")
            payload = read(medium)
            rows.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(payload), n))
        yield _batch(rows, types, names)


def joined(lists: DataFrame, held: DataFrame) -> DataFrame:
    """(key, n, seq, digest, data) of every reference of lists; a digest of many is dealt to copies of its chunk."""
    hot = cut(lists.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > HOT).select("digest", F.ceil(F.col("times") / HOT).alias("copies")))
    columns = ["key", "n", "seq", "digest", "data"]
    cold = lists.join(hot, "digest", "left_anti").join(held, "digest").select(columns)
    salted = lists.join(hot, "digest").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("copies")))
    copied = held.join(hot, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    return cold if hot.isEmpty() else cold.unionByName(salted.join(copied, ["digest", "salt"]).select(columns))


def rebuilt(texts: DataFrame) -> DataFrame:
    """Facts of every distinct medium, read from its rebuilt form."""
    lists, held = cut(chunk_lists(texts)), chunk_store(texts)
    chunk = F.struct("seq", "digest", "data")
    single = lists.filter("n = 1").join(held, "digest").select("key", "n", F.array(chunk).alias("chunks"))
    several = joined(lists.filter("n > 1"), held).groupBy("key", "n").agg(F.collect_list(chunk).alias("chunks"))
    return in_arrow(single, _rebuild, FACTS).unionByName(in_arrow(several, _rebuild, FACTS))


def store_media(docs: DataFrame) -> DataFrame:
    """Each document with the facts of its rebuilt medium."""
    texts = docs.select(text_or_empty().alias("text"))

    def keyed(batches):
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([digest(store(payload_of(x))) for x in raw], pa.binary()), pa.array(map(len, raw), pa.int64())], names=["doc_id", "key", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    listed = in_arrow(rows, keyed, "doc_id long, key binary, n_bytes long")
    facts = [x.split()[0] for x in FACTS.split(", ")][1:]
    return listed.join(rebuilt(texts), "key").select("doc_id", "n_bytes", *facts)
