"""Bloom filters in the layout of the older table format: a bit array, then one byte with the number of probes.

Parquet's own filters serve the store; these are for filters that come from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Multiplier, last shift and seed of the hash; share of the bits a key that become probes; bounds of a filter.
MULTIPLIER, LAST_SHIFT, SEED = 0xC6A4A793, 24, 0xBC9F1D34
PROBES_PER_BIT, MOST_PROBES, LEAST_BITS = 0.69, 30, 64
_WORD = 0xFFFFFFFF


def bloom_hash(key: bytes, seed: int = SEED) -> int:
    """32 bits: little-endian words of four bytes, each added, multiplied and folded; a shorter last one folds further."""
    h = seed ^ len(key) * MULTIPLIER & _WORD
    for word in (key[i : i + 4] for i in range(0, len(key), 4)):
        h = (h + int.from_bytes(word, "little")) * MULTIPLIER & _WORD
        h ^= h >> (16 if len(word) == 4 else LAST_SHIFT)
    return h


def _spots(key: bytes, probes: int, bits: int) -> np.ndarray:
    h = bloom_hash(key)
    step = (h >> 17 | h << 15) & _WORD
    return (h + np.arange(probes, dtype=np.uint64) * np.uint64(step) & np.uint64(_WORD)) % np.uint64(bits)


def build(keys: Iterable[bytes], bits_per_key: int = 10) -> bytes:
    keys = list(keys)
    probes = min(MOST_PROBES, max(1, int(bits_per_key * PROBES_PER_BIT)))
    bits = np.zeros(-(-max(LEAST_BITS, len(keys) * bits_per_key) // 8) * 8, np.uint8)
    for key in keys:
        bits[_spots(key, probes, len(bits))] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([probes])


def may_hold(key: bytes, held: bytes) -> bool:
    """False only for keys that were not put in; an unknown number of probes matches everything, a stump nothing."""
    if len(held) < 2:
        return False
    if held[-1] > MOST_PROBES:
        return True
    spots = _spots(key, held[-1], 8 * (len(held) - 1))
    bits = np.frombuffer(held, np.uint8)[(spots >> np.uint64(3)).astype(int)] >> (spots & np.uint64(7)).astype(np.uint8)
    return bool((bits & 1).all())
