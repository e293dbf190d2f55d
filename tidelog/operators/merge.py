"""Merge operators: how operands fold over an optional base, as Column aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codec import decode_u64, encode_u64


def _two_to_64() -> Column:
    """2**64, which fits no integer type."""
    return F.lit(str(1 << 64)).cast("decimal(20,0)")


class MergeOperator:
    """operands() aggregates the operands of a key (nulls are other rows); full() puts them on the base.

    associative: operands may be combined without a base, in any grouping, so stretches can be folded early; combine() then
    aggregates what operands() gave for them."""

    name = "operator"
    associative = False

    def operands(self, value: Column, seq: Column) -> Column:
        raise NotImplementedError

    def full(self, base: Column, operands: Column) -> Column:
        raise NotImplementedError

    def combine(self, folds: Column) -> Column:
        return F.sum(folds)

    def partial(self, operands: Column) -> Column:
        """The one operand that stands for several."""
        return operands


class Add(MergeOperator):
    """Sum of integers that stay within 64 bits; a missing base is 0."""

    name, associative = "add", True

    def operands(self, value, seq):
        return F.sum(value)

    def full(self, base, operands):
        return F.coalesce(base, F.lit(0)) + operands


class UInt64Add(MergeOperator):
    """Eight-byte little-endian counters, wrapping at 2**64; other lengths count as 0."""

    name, associative = "uint64add", True

    def operands(self, value, seq):
        return F.sum(decode_u64(value))

    def full(self, base, operands):
        return encode_u64(F.pmod(F.coalesce(decode_u64(base), F.lit(0)).cast("decimal(38,0)") + operands, _two_to_64()))

    def partial(self, operands):
        return encode_u64(F.pmod(operands, _two_to_64()))


class Wrap64Add(MergeOperator):
    """As UInt64Add over decimal values."""

    name, associative = "wrap64add", True

    def operands(self, value, seq):
        return F.sum(value.cast("decimal(38,0)"))

    def full(self, base, operands):
        return F.pmod(F.coalesce(base.cast("decimal(38,0)"), F.lit(0)) + operands, _two_to_64()).cast("decimal(20,0)")


class Append(MergeOperator):
    """Operands joined after the base, oldest first."""

    name = "append"

    def __init__(self, delimiter: str = ""):
        self.delimiter = delimiter

    def operands(self, value, seq):
        kept = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("s"), value.alias("v")))))
        return F.array_join(F.transform(kept, lambda x: x["v"]), self.delimiter)

    def full(self, base, operands):
        return F.when(base.isNull(), operands).otherwise(F.concat(base, F.lit(self.delimiter), operands))


class Max(MergeOperator):
    """The greatest of base and operands."""

    name, associative = "max", True

    def operands(self, value, seq):
        return F.max(value)

    def combine(self, folds):
        return F.max(folds)

    def full(self, base, operands):
        return F.greatest(base, operands)


class Custom(MergeOperator):
    """From two functions over Columns: ordered operands (an array) to their fold, and base and fold to the value."""

    def __init__(self, fold: Callable[[Column], Column], full: Callable[[Column, Column], Column], name: str = "custom"):
        self.fold, self._full, self.name = fold, full, name

    def operands(self, value, seq):
        kept = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("s"), value.alias("v")))))
        return self.fold(F.transform(kept, lambda x: x["v"]))

    def full(self, base, operands):
        return self._full(base, operands)
