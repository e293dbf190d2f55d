"""SentencePiece encoding with byte offsets, and decoding.

Text is normalised here as the library does it: the longest prefix of the rest that the model's compiled character
map knows is replaced by its rule's result, else one character is kept; spaces become U+2581, with the dummy one in
front.  Every normalised byte records the source byte that it came from, so each piece's normalised span projects
to a span of the original UTF-8 bytes.  The library chooses the pieces; their lengths must add up to our normal form,
else the row fails loudly.

Cases: null and empty texts have no pieces; unknown pieces (of models without bytes) cover what they stand for; of rules
that start alike the longest wins, so there are no ties; repeated rows get equal rows; very long texts are encoded whole;
no rows, no pieces; further columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

SPACE = "▁".encode()


class CharacterMap:
    """The compiled map: a double-array trie over rule prefixes, then zero-ended results."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.results = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes of text that the longest rule takes, its result)."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node, best = step(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[i]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        return best and (best[0], self.results[best[1] : self.results.index(b"\0", best[1])])


class Normaliser:
    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.map, self.dummy, self.squeeze, self.space = CharacterMap(charsmap), dummy_prefix, squeeze, SPACE if escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normal form and, for each of its bytes and its end, the source offset."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._plain(text)
        pieces, at = [], 0
        while at < len(text):
            taken, result = self.map.longest(text, at) or (n := _char(text[at]), text[at : at + n])
            pieces.append((at, result))
            at += taken
        end = len(text)
        if self.squeeze:
            pieces = _squeezed(pieces)
            if not pieces:
                return b"", np.zeros(1, np.int64)
            if pieces[-1][1] != text[pieces[-1][0] :]:
                end = min(end, pieces[-1][0] + max(1, len(pieces[-1][1])))
        if self.dummy:
            pieces.insert(0, (pieces[0][0] if self.squeeze else 0, b" "))
        out, source = bytearray(), []
        for start, result in pieces:
            result = result.replace(b" ", self.space)
            out += result
            source += [start] * len(result)
        return bytes(out), np.array([*source, end])

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(text, np.uint8)
        wide = np.where(raw == 0x20, len(self.space), 1)
        source = np.repeat(np.arange(len(raw)), wide)
        head = len(self.space) * self.dummy
        return (self.space * self.dummy) + text.replace(b" ", self.space), np.concatenate((np.zeros(head, np.int64), source, [len(raw)]))


def _char(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def _squeezed(pieces: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Without spaces at either end, and with one for each run of them."""
    out: list[tuple[int, bytes]] = []
    for start, result in pieces:
        last_space = not out or out[-1][1].endswith(b" ")
        result = result.lstrip(b" ") if last_space else result
        if result:
            out.append((start, result))
    while out and out[-1][1].endswith(b" "):
        start, result = out.pop()
        if result.rstrip(b" "):
            out.append((start, result.rstrip(b" ")))
    return out


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.normal = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        one_byte = pb.ModelProto.SentencePiece.BYTE
        self.length = np.array([1 if p.type == one_byte else len(p.piece.encode()) for p in model.pieces])
        self.unknown = self.library.unk_id()

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and their spans in the bytes of the text."""
        ids = self.library.encode(text, add_bos=False, add_eos=False)
        normal, source = self.normal(text.encode())
        sizes = self.length[ids] if ids else np.zeros(0, np.int64)
        if self.unknown in ids:  # its name is not what it stands for
            said = self.library.encode(text, add_bos=False, add_eos=False, out_type=str)
            sizes = np.array([len(p.encode()) if i == self.unknown else n for i, n, p in zip(ids, sizes, said, strict=True)])
        ends = np.cumsum(sizes)
        if len(normal) != (ends[-1] if ids else 0):
            raise ValueError("pieces do not cover the normalised text")
        return ids, source[np.concatenate(([0], ends[:-1])).astype(np.int64)] if ids else ends, source[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


ENCODED = "doc_id long, ids array<int>, starts array<long>, ends array<long>"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Each document's ids, and where in the bytes of its text each piece starts and ends."""

    def run(batches):
        c = codec(path)
        for b in batches:
            rows = [c.encode(t or "") for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), *(pa.array([r[i].tolist() for r in rows], pa.list_(pa.int64())) for i in (1, 2))]
            yield pa.record_batch(columns, names=["doc_id", "ids", "starts", "ends"])

    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, ENCODED)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids are the empty text."""

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return in_arrow(ids.selectExpr("cast(doc_id as long) doc_id", "ids"), run, "doc_id long, text string")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes; path: the model's file, there on every executor."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        c = codec(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, start, end = c.encode(text or "")
                rows.append((doc, len(ids), sha(str(ids)[1:-1].replace(" ", "").encode()), sha(c.decode(ids).encode()), sha(np.concatenate((start, end)).astype("<i8").tobytes())))
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, SCHEMA)
