"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; where none is named, one of our own if there is one machine only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows that a Python worker is handed at once; texts of some KB make that a few MB, on both sides.
BATCH_ROWS = 1000


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow over small record batches.  The batch size is the session's; larger ones would hold tens of MB of text
    several times over in each worker."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(f, schema)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that a lost executor costs one step only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def least_hashed(df: DataFrame, n: int, k: int, seed: int | None = None) -> DataFrame:
    """(doc_id): the k distinct ids of least hash, of about n.  Only some 2 k rows reach the task that orders them."""
    h = F.xxhash64("doc_id") if seed is None else F.xxhash64("doc_id", F.lit(seed))
    bound = min(2**63 - 1, int(2**64 * min(1.0, (2 * k + 50) / max(n, 1))) - 2**63)
    return df.select("doc_id", h.alias("h")).filter(F.col("h") <= bound).distinct().orderBy("h", "doc_id").limit(k).select("doc_id")


def slices(items: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges over items, each of about limit bytes or of one longer item."""
    start = size = 0
    for i, x in enumerate(items):
        if size and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x) + 1
    if start < len(items):
        yield start, len(items)
