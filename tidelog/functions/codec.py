"""Key helpers and byte codecs as Columns; plain-Python forms where a single value is handled on the driver."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Corruption


def decode_u64(value: Column) -> Column:
    """Eight little-endian bytes to a decimal; any other length is 0, null stays null."""
    digit = lambda i: F.conv(F.hex(F.substring(value, i + 1, 1)), 16, 10).cast("decimal(20,0)")
    total = functools.reduce(lambda a, b: a + b, (digit(i) * F.lit(str(256**i)).cast("decimal(20,0)") for i in range(8)))
    return F.when(value.isNull(), F.lit(None)).when(F.length(value) == 8, total).otherwise(F.lit(0)).cast("decimal(38,0)")


def encode_u64(number: Column) -> Column:
    """A decimal in [0, 2**64) to eight little-endian bytes."""
    byte = lambda i: F.lpad(F.conv(F.pmod(F.floor(number / F.lit(str(256**i)).cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(256).cast("decimal(38,0)")).cast("string"), 10, 16), 2, "0")
    return F.when(number.isNotNull(), F.unhex(F.concat(*(byte(i) for i in range(8)))))


def pack_trailer(seq: Column, code: Column) -> Column:
    return F.shiftleft(seq, 8).bitwiseOR(code)


def unpack_trailer(trailer: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(trailer, 8), trailer.bitwiseAND(F.lit(255))


def file_name(number: Column, kind: str) -> Column:
    return F.format_string(f"%06d.{kind}", number)


def log_number(name: Column) -> Column:
    """Of a segment name NNNNNN.log; null for any other name."""
    found = F.regexp_extract(name, r"^(\d+)\.log$", 1)
    return F.when(found != "", found.cast("long"))


def fixed_prefix(key: Column, n: int) -> Column:
    """First n characters; null where the key is shorter (out of domain)."""
    return F.when(F.length(key) >= n, F.substring(key, 1, n))


def capped_prefix(key: Column, n: int) -> Column:
    return F.substring(key, 1, n)


def successor(prefix: str | bytes) -> str | bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    if isinstance(prefix, str):
        last = len(prefix) - 1
        while last >= 0 and ord(prefix[last]) == 0x10FFFF:
            last -= 1
        if last < 0:
            return None
        code = ord(prefix[last]) + 1
        return prefix[:last] + chr(0xE000 if 0xD800 <= code < 0xE000 else code)
    last = len(prefix) - 1
    while last >= 0 and prefix[last] == 0xFF:
        last -= 1
    return prefix[:last] + bytes([prefix[last] + 1]) if last >= 0 else None


def separator(start: bytes, limit: bytes) -> bytes:
    """A short key in [start, limit)."""
    n = next((i for i, (a, b) in enumerate(zip(start, limit, strict=False)) if a != b), min(len(start), len(limit)))
    if n < min(len(start), len(limit)) and start[n] < 0xFF and start[n] + 1 < limit[n]:
        return start[:n] + bytes([start[n] + 1])
    return start


def short_successor(key: bytes) -> bytes:
    """A short key at or above the given one."""
    n = next((i for i, b in enumerate(key) if b != 0xFF), None)
    return key if n is None else key[:n] + bytes([key[n] + 1])


def put_fixed(n: int, width: int = 8) -> bytes:
    """Little-endian, in 4 or 8 bytes."""
    return n.to_bytes(width, "little")


def get_fixed(data: bytes, at: int = 0, width: int = 8) -> int:
    if at + width > len(data):
        raise Corruption("fixed integer")
    return int.from_bytes(data[at : at + width], "little")


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def get_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next offset)."""
    n = 0
    for i in range(10):
        if at + i >= len(data):
            break
        n |= (data[at + i] & 0x7F) << 7 * i
        if data[at + i] < 0x80:
            if n >= 1 << 64:
                break
            return n, at + i + 1
    raise Corruption("varint")


def put_slice(data: bytes) -> bytes:
    return put_varint(len(data)) + data


def get_slice(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = get_varint(data, at)
    if at + n > len(data):
        raise Corruption("slice")
    return data[at : at + n], at + n


#: CRC-32C's reversed polynomial, and the constant and rotation that stored checksums are masked with.
CASTAGNOLI = 0x82F63B78
MASK_DELTA, MASK_BITS = 0xA282EAD8, 15


@functools.cache
def _crc_table() -> list[int]:
    """Byte table of the Castagnoli polynomial, made from its rule."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (CASTAGNOLI if i & 1 else 0)
        out.append(i)
    return out


def crc32c(data: bytes, crc: int = 0) -> int:
    table, crc = _crc_table(), crc ^ 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def mask_crc(crc: int) -> int:
    return ((crc >> MASK_BITS | crc << 32 - MASK_BITS) + MASK_DELTA) & 0xFFFFFFFF


def unmask_crc(masked: int) -> int:
    rot = (masked - MASK_DELTA) & 0xFFFFFFFF
    return (rot >> 32 - MASK_BITS | rot << MASK_BITS) & 0xFFFFFFFF
