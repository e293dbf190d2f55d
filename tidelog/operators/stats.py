"""Statistics of segment files, with true bounds over all entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, MERGE, RANGE_DELETE, SINGLE_DELETE


def properties(log: DataFrame, by: str = "file_no") -> DataFrame:
    count = lambda *ops: F.count(F.when(F.col("op").isin(*ops), 1))
    return log.groupBy("cf", by).agg(
        F.count(F.lit(1)).alias("num_entries"),
        count(DELETE, SINGLE_DELETE).alias("num_deletions"),
        count(MERGE).alias("num_merges"),
        count(RANGE_DELETE).alias("num_range_deletions"),
        F.sum(F.octet_length("key")).alias("raw_key_size"),
        F.sum(F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))).alias("raw_value_size"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


def key_ranges(log: DataFrame, by: str = "file_no") -> DataFrame:
    return log.groupBy("cf", by).agg(F.min("key").alias("smallest"), F.max(F.greatest(F.col("key"), F.coalesce("end_key", "key"))).alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def memory_usage(log: DataFrame) -> DataFrame:
    size = F.octet_length("key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)) + 8
    return log.groupBy("cf").agg(F.sum(size).alias("bytes"))
