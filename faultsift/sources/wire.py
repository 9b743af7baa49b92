"""Event sources: JSON or Parquet records, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.contracts import WIRE_SCHEMA


def wire_to_columns(wire: DataFrame) -> DataFrame:
    """Wire names to column names; arrival order within an instant is ``seq``."""
    return wire.select(
        F.col("eventId").alias("event_id"),
        F.col("receivedAt").alias("received_at"),
        F.lit(0).alias("seq"),
        "service", "level", "message", "platform",
        F.col("exceptionType").alias("exception_type"),
        "stacktrace", "release", "payload")


def read_events(spark: SparkSession, path: str, fmt: str = "json",
                multiline: bool = False) -> DataFrame:
    """A batch of events; ``multiline`` reads files that hold one JSON array each."""
    reader = spark.read.schema(WIRE_SCHEMA)
    if fmt == "json":
        reader = reader.option("multiLine", multiline)
    return wire_to_columns(reader.format(fmt).load(path))


def stream_events(spark: SparkSession, path: str, fmt: str = "json",
                  max_files_per_trigger: int = 100) -> DataFrame:
    """The same events as an unbounded stream over a landing folder."""
    stream = (spark.readStream.schema(WIRE_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .format(fmt).load(path))
    return wire_to_columns(stream)
