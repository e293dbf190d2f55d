"""Compaction filters as Columns: what to keep, remove or change; and operand filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    level: int = 0
    is_full_compaction: bool = True
    is_manual_compaction: bool = True


class CompactionFilter:
    """remove() and change() see the level, key and value; operands() keeps or drops merge operands."""

    name = "filter"

    def remove(self, level: int, key: Column, value: Column) -> Column:
        return F.lit(False)

    def change(self, level: int, key: Column, value: Column) -> Column:
        return value

    def keep_operand(self, level: int, key: Column, operand: Column) -> Column:
        return F.lit(True)


class RemoveByValuePrefix(CompactionFilter):
    name = "remove-by-value-prefix"

    def __init__(self, prefix: str):
        self.prefix = prefix

    def remove(self, level, key, value):
        return F.coalesce(F.startswith(value, F.lit(self.prefix)), F.lit(False))


class AppendSuffix(CompactionFilter):
    name = "append-suffix"

    def __init__(self, suffix: str):
        self.suffix = suffix

    def change(self, level, key, value):
        return F.concat(value, F.lit(self.suffix))


class RemoveOperandByValue(CompactionFilter):
    name = "remove-operand-by-value"

    def __init__(self, operand):
        self.operand = operand

    def keep_operand(self, level, key, operand):
        return operand != F.lit(self.operand)


class DropKeyPrefix(CompactionFilter):
    name = "drop-key-prefix"

    def __init__(self, prefix: str):
        self.prefix = prefix

    def remove(self, level, key, value):
        return F.startswith(key, F.lit(self.prefix))


def prefix_drop_factory(prefix: str) -> Callable[[Context], CompactionFilter]:
    """A fresh filter for every compaction."""
    return lambda context: DropKeyPrefix(prefix)
