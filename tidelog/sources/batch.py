"""Write batches: records in order, stamped with consecutive sequences as one commit."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import Corruption
from ..schema import DEFAULT_CF, DELETE, MERGE, OPS, PUT, RANGE_DELETE
from ..session import written


def assign_sequences(df: DataFrame, order: list[str], last: int = 0, partitions: int | None = None) -> DataFrame:
    """Adds seq = last + 1, + 2, ... in the given order: sorted ranges number their own rows, after the counts of those
    before them, so no task sees all rows.  The ranges are written first: their bounds come from a sample that another run of
    the same plan would draw anew."""
    ranged = written(df.repartitionByRange(*([partitions] if partitions else []), *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    numbered = ranged.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn("seq", F.col("_at") + F.col("_before") + last).drop("_part", "_at", "_before")


@dataclass
class WriteBatch:
    """Records (cf, op, key, value, end_key), applied together or not at all."""

    records: list[tuple] = field(default_factory=list)
    sequence: int = 0

    def put(self, key, value, cf: str = DEFAULT_CF) -> WriteBatch:
        self.records.append((cf, PUT, key, value, None))
        return self

    def delete(self, key, cf: str = DEFAULT_CF) -> WriteBatch:
        self.records.append((cf, DELETE, key, None, None))
        return self

    def merge(self, key, operand, cf: str = DEFAULT_CF) -> WriteBatch:
        self.records.append((cf, MERGE, key, operand, None))
        return self

    def delete_range(self, begin, end, cf: str = DEFAULT_CF) -> WriteBatch:
        self.records.append((cf, RANGE_DELETE, begin, None, end))
        return self

    def clear(self) -> None:
        self.records, self.sequence = [], 0

    def __len__(self) -> int:
        return len(self.records)

    def byte_size(self) -> int:
        size = lambda x: len(x.encode()) if isinstance(x, str) else len(x) if isinstance(x, (bytes, bytearray)) else 0
        return 12 + sum(1 + sum(map(size, (k, v, e))) for _, _, k, v, e in self.records)

    def contents(self) -> bytes:
        """The batch as bytes; of() reads it back."""
        return json.dumps([self.sequence, self.records], default=lambda b: {"hex": bytes(b).hex()}).encode()

    @classmethod
    def of(cls, contents: bytes) -> WriteBatch:
        try:
            sequence, records = json.loads(contents, object_hook=lambda d: bytes.fromhex(d["hex"]))
            return cls([tuple(r) for r in records], sequence)
        except (ValueError, TypeError, KeyError) as e:
            raise Corruption("write batch") from e

    def rows(self) -> Iterator[tuple]:
        """(cf, key, seq, op, value, end_key), each record one sequence."""
        for i, (cf, op, key, value, end) in enumerate(self.records):
            yield cf, key, self.sequence + i, op, value, end

    def iterate(self, handler: dict[str, Callable[..., Any]], count: int | None = None) -> None:
        """Calls handler[op](cf, key, value, end_key) for each record; unknown kinds and wrong counts are corruption."""
        if count is not None and count != len(self.records):
            raise Corruption(f"{len(self.records)} records, {count} counted")
        for cf, op, key, value, end in self.records:
            if op not in OPS:
                raise Corruption(f"record kind {op}")
            if op in handler:
                handler[op](cf, key, value, end)
