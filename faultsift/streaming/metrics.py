"""Outcome counters of streams and batches, kept as a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from faultsift.sources import sinks

SCHEMA = "source string, run string, batch bigint, at timestamp, name string, metric string, value bigint"


def append_counters(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    if rows:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


class CounterListener(StreamingQueryListener):
    """Appends every observed metric of every batch of the named queries to a table.

    One small row set a batch, whatever the batch holds: Spark gathers the values with the tasks of the batch.
    """

    def __init__(self, spark: SparkSession, path: str, queries: set[str]):
        self.spark, self.path, self.queries = spark, path, queries

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if p.name not in self.queries:
            return
        at = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).replace(tzinfo=None)
        append_counters(self.spark, self.path, [
            (p.name, str(p.id), p.batchId, at, name, metric, int(value))
            for name, row in (p.observedMetrics or {}).items()
            for metric, value in row.asDict().items() if value is not None])

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


class Counted:
    """A batch frame whose metrics go to the same table once an action has run on it."""

    def __init__(self, df: DataFrame, name: str, *metrics):
        self._observation, self.name = Observation(name), name
        self.df = df.observe(self._observation, *metrics)

    def append(self, path: str, source: str, run: str, at: dt.datetime) -> None:
        append_counters(self.df.sparkSession, path, [
            (source, run, 0, at, self.name, metric, int(value)) for metric, value in self._observation.get.items()])


def drain(spark: SparkSession) -> None:
    """Waits until the listeners have seen all that has happened."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(source, name, metric, value): a batch that was run again counts once, as its last report says."""
    if not sinks.path_exists(spark, path):
        return spark.createDataFrame([], "source string, name string, metric string, value bigint")
    once = (spark.read.schema(SCHEMA).parquet(path)
            .groupBy("source", "run", "batch", "name", "metric").agg(F.max_by("value", "at").alias("value")))
    return once.groupBy("source", "name", "metric").agg(F.sum("value").alias("value"))
