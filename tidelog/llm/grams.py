"""Word and character n-gram hashes of many texts at once, on byte arrays.

Words are runs of bytes of a class; every class here treats bytes from 0x80 alike, so UTF-8
sequences never split.  A word's hash is a polynomial over its bytes modulo 2**64, read from one
running sum, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_MUL, _SEED = 0x9E3779B97F4A7C15, 20240229
_INV = pow(_MUL, -1, 1 << 64)
_LETTER = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: dict[str, np.ndarray] = {}


def word_class(pattern_is_word) -> np.ndarray:
    return np.array([bool(pattern_is_word(i)) for i in range(256)])


#: Everything but ASCII white space.
PLAIN = word_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters (lower-cased before), digits and everything outside ASCII.
LETTERS = word_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Upper-case ASCII letters to lower case.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for name, base in (("up", _MUL), ("down", _INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Batch:
    """Texts as one byte array with a line feed after each; words, their owners and their hashes."""

    def __init__(self, texts: list[bytes], kind: np.ndarray = PLAIN, lower: bool = False):
        self.n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.text_end = np.cumsum(lengths + 1)
        self.text_start = self.text_end - lengths - 1
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = LOWER[raw] if lower else raw
        is_word = kind[self.raw]
        if self.n:
            is_word[self.text_end - 1] = False
        self.is_word = is_word
        edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.owner = np.searchsorted(self.text_end, self.start, side="right")
        self.n_words = np.bincount(self.owner, minlength=self.n)
        self._sum: np.ndarray | None = None

    def prefix_sum(self) -> np.ndarray:
        if self._sum is None:
            up, _ = powers(len(self.raw))
            self._sum = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(_LETTER[self.raw] * up, out=self._sum[1:])
        return self._sum

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        total, (_, down) = self.prefix_sum(), powers(len(self.raw))
        return mix((total[end] - total[start]) * down[start])

    def words(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)

    def word_grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of k words inside one text."""
        if len(words) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(words) - k + 1
        at = np.flatnonzero(self.owner[:n] == self.owner[k - 1 :])
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * U(_MUL) + words[j : j + n]
        return at, mix(total[at])

    def char_grams(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(owner, bucket) of every window of k bytes inside one text."""
        n = len(self.raw) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint32)
        for j in range(k):
            total = total * np.uint32(0x01000193) + self.raw[j : j + n]
        total = (total * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        owner = np.repeat(np.arange(self.n), self.text_end - self.text_start)[:n]
        inside = np.arange(n) + k <= self.text_end[owner] - 1
        return owner[inside], total[inside].astype(np.int64)
