"""Tails the write log: segment files as a stream, reduced batch by batch to the records that reads still need.

Sequences, not arrival, order versions, so late files change nothing about the result.  A batch writes only what it
brought: the newest record of each of its keys (of keys with merges, all since the newest put or delete) and its range
deletes, as a segment of its own; a batch that runs again overwrites itself.  The view is the same read as of a log: newest
records, merges folded, range deletes applied to every kind of record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..operators import visibility
from ..operators.merge import MergeOperator
from ..schema import MERGE, RANGE_DELETE
from ..session import scratch


def follow(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """The segments under path as a stream; files_per_trigger holds back a slow reader."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def reduced(batch: DataFrame) -> DataFrame:
    """Without point records that a newer put or delete of the batch hides; deletes and range deletes stay, as what they hide
    may have come before or come later."""
    end = F.when(~F.col("op").isin(MERGE, RANGE_DELETE), F.col("seq"))
    newest = F.max(end).over(W.partitionBy("cf", "key"))
    return batch.withColumn("newest", newest).filter((F.col("op") == RANGE_DELETE) | F.col("newest").isNull() | (F.col("seq") >= F.col("newest"))).drop("newest")


def materialise(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps what the batches brought under out/batch=<id>."""
    write = lambda df, batch: reduced(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view(spark: SparkSession, out: str, schema: StructType, merge: MergeOperator | None = None) -> DataFrame:
    """(cf, key, seq, value) of the live keys of what was tailed so far; a record that came twice counts once.  What newer
    records hide is not kept, so the past cannot be read here."""
    held = spark.read.schema(schema).parquet(out).select(*schema.fieldNames())
    return visibility.resolve(visibility.deduped(held) if merge is not None else held, merge=merge)


def compact(spark: SparkSession, out: str, to: str, schema: StructType) -> DataFrame:
    """What was tailed so far as one segment under to, for a tail of many batches."""
    reduced(visibility.deduped(spark.read.schema(schema).parquet(out).select(*schema.fieldNames()))).write.parquet(f"{to}/batch=0")
    return spark.read.schema(schema).parquet(to)


def drain(log: DataFrame, merge: MergeOperator | None = None, folder: str | None = None) -> DataFrame:
    """Writes the log as segments, tails them to the end, and returns the live view."""
    spark = log.sparkSession
    folder = folder or scratch(spark, "tail")
    log.withColumn("segment", F.floor((F.col("seq") - 1) / 1000)).repartition("segment").drop("segment").write.mode("overwrite").parquet(f"{folder}/log")
    materialise(follow(spark, f"{folder}/log", log.schema), f"{folder}/view", f"{folder}/state").awaitTermination()
    return view(spark, f"{folder}/view", log.schema, merge)
