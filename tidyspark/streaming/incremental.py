"""Incremental cleaning of new files with Structured Streaming: an extension, not something the batch plan needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..contract import Contract


def clean_stream(spark: SparkSession, folder: str, schema: StructType, contract: Contract, event_time: str, late: str = "7 days") -> DataFrame:
    """Valid canonical rows of files as they arrive, each once within the watermark."""
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")  # as in the batch plan
    rows = contract.clean(spark.readStream.schema(schema).parquet(folder))
    # Watermarks need a timestamp with the session's zone; equal rows have equal copies of it.
    timed = rows.withColumn("_at", F.col(event_time).cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(contract.names).drop("_at")


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in what is there and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
