"""Streaming ingest of JSONL chunks: files that arrive in a folder are merged into a store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import store

CHUNK = "id string, text string, metadata string"


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, buckets: int = store.BUCKETS) -> StreamingQuery:
    """Merge every new chunk by its id; a later batch goes over an earlier one, a batch that is run again changes nothing."""
    rows = spark.readStream.schema(CHUNK).json(folder, pathGlobFilter="*.jsonl").where("id is not null")
    try:
        store.read(spark, target)
    except (FileNotFoundError, AnalysisException):
        store.create(spark, target, "id", "batch", buckets)

    def write(batch: DataFrame, number: int) -> None:
        store.merge(batch.withColumn("batch", F.lit(number).cast("bigint")), target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    return store.read(spark, target).select("id", "text", "metadata")
