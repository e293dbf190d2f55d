"""A corpus pipeline of five stages; each reads what the one before it wrote.

Rows: quality rules drop documents, the Jaccard join keeps one of each class of near copies, the secret scan replaces
secrets in texts, the mix repeats or leaves out documents so that sources come near their targets, and the last stage
encodes what is left.

Cases: null and empty texts fail the quality rules; null ids and sources are kept as they are; of copies, near copies and
repeated rows one stays until the mix repeats it; very long texts pass whole; no documents, no rows; further columns are
carried along, whatever their names, up to the last stage.  What a stage wrote goes as soon as the next one has read it;
the last stage's table is the result and goes with the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import jaccard_join, mixing, pieces, quality, secrets_scan
from tidelog.llm.common import remove, table
from tidelog.llm.queries import piece_model
from tidelog.session import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, piece_model())


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", jaccard_stage), ("secret scans", secrets_stage), ("mixing", mixing_stage), ("SentencePiece", encoding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs


#: The classifier, the MinHash values and the tokenizer have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
