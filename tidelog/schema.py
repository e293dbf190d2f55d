"""The write log: one row a record, newest version by seq.  Options and their defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from .errors import InvalidArgument

PUT, DELETE, SINGLE_DELETE, MERGE, RANGE_DELETE = "PUT", "DELETE", "SINGLE_DELETE", "MERGE", "RANGE_DELETE"
OPS = (PUT, DELETE, SINGLE_DELETE, MERGE, RANGE_DELETE)
#: Record type codes of the packed trailer.
OP_CODES = {DELETE: 0, PUT: 1, MERGE: 2, SINGLE_DELETE: 7, RANGE_DELETE: 15}
MAX_SEQ = (1 << 56) - 1
DEFAULT_CF = "default"


def log_schema(value: T.DataType | None = None, key: T.DataType | None = None) -> T.StructType:
    key, value = key or T.StringType(), value or T.StringType()
    return T.StructType(
        [
            T.StructField("cf", T.StringType(), False),
            T.StructField("key", key, False),
            T.StructField("seq", T.LongType(), False),
            T.StructField("op", T.StringType(), False),
            T.StructField("value", value),
            T.StructField("end_key", key),
        ]
    )


#: Codecs of segment files; anything else is refused.
CODECS = ("none", "snappy", "gzip", "zstd", "lz4")


@dataclass(frozen=True)
class KeyOrder:
    """An order of keys of one's own, by a sort key: a key is stored as encode(key), and the byte order of these is the order.

    The Column forms do the same on the executors.  Compaction filters see stored keys."""

    name: str
    encode: Callable[[str], str]
    decode: Callable[[str], str]
    encode_column: Callable[[Column], Column]
    decode_column: Callable[[Column], Column]


@dataclass
class Options:
    """Engine options.  Those that only shape byte layouts elsewhere are accepted and have no effect here."""

    comparator: str | KeyOrder = "bytewise"
    create_if_missing: bool = True
    error_if_exists: bool = False
    read_only: bool = False
    value_type: T.DataType = field(default_factory=T.StringType)
    merge_operator: Any = None
    compaction_filter: Any = None
    compaction_filter_factory: Any = None
    prefix_extractor: Any = None
    compression: str = "none"
    compression_per_level: tuple[str, ...] | None = None
    compaction_style: str = "level"
    write_buffer_rows: int = 1000
    write_buffer_bytes: int = 4 << 20
    max_file_rows: int = 1_000_000
    level0_file_num_compaction_trigger: int = 4
    level0_slowdown_writes_trigger: int = 20
    level0_stop_writes_trigger: int = 36
    max_bytes_for_level_base: int = 10 << 20
    fifo_max_table_files_size: int = 1 << 30
    #: Files that compactions replaced stay so long for the readers that hold them.
    obsolete_file_seconds: float = 600.0
    universal_size_ratio: int = 1
    universal_min_merge_width: int = 2
    universal_max_size_amplification_percent: int = 200
    no_effect: dict = field(default_factory=lambda: {"paranoid_checks": False, "block_size": 4096, "block_restart_interval": 16, "max_open_files": 1000, "block_cache": None})

    def __post_init__(self) -> None:
        if not isinstance(self.comparator, KeyOrder) and self.comparator not in ("bytewise", "reverse_bytewise"):
            raise InvalidArgument(f"comparator {self.comparator}")
        if self.compaction_style not in ("level", "universal", "fifo"):
            raise InvalidArgument(f"compaction style {self.compaction_style}")
        for codec in (self.compression, *(self.compression_per_level or ())):
            if codec not in CODECS:
                raise InvalidArgument(f"compression {codec}")

    @property
    def order_name(self) -> str:
        return self.comparator.name if isinstance(self.comparator, KeyOrder) else self.comparator

    def compression_for(self, level: int) -> str:
        per = self.compression_per_level
        return per[min(level, len(per) - 1)] if per else self.compression
