"""Structured Streaming forms of ingest, rollups and silence; alerts are in ``alerting``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from faultsift.contracts import DEFAULTS, Params
from faultsift.functions.fingerprint import with_fingerprint
from faultsift.operators import ingest
from faultsift.operators.pyramid import Pyramid
from faultsift.operators.store import EventStore
from faultsift.session import cut

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


# -- J1 -------------------------------------------------------------------------------------------
def ingest_stream(raw: DataFrame, watermark: str = "10 minutes",
                  params: Params = DEFAULTS) -> DataFrame:
    """Validated, de-duplicated, fingerprinted events; ids are remembered per watermark.

    Each batch reports its valid and rejected records as the observed metrics "ingest" and its new events as
    "unique". Ids that come again beyond the watermark are known to ``store_stream`` only.
    """
    use_rocksdb(raw.sparkSession)
    checked = ingest.validate(ingest.assign_event_ids(raw)).observe("ingest", *outcome_counts())
    valid = checked.filter("error IS NULL").drop("error")
    unique = valid.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(
        ["event_id"]).observe("unique", F.count(F.lit(1)).alias("stored"))
    return with_fingerprint(ingest.resolve_legacy(unique), params.fingerprint_version)


def store_stream(raw: DataFrame, path: str, checkpoint: str, params: Params = DEFAULTS,
                 available_now: bool = True) -> StreamingQuery:
    """Each batch goes into the event store under ``path``, which knows every stored id; no state is kept here."""
    def batch(df: DataFrame, batch_id: int) -> None:
        events = EventStore(df.sparkSession, path)
        events.ingest(df, params, "stream", batch_id)
        events.forget()
        for table in (events.events, events.filters):
            table.vacuum()

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# -- J2 -------------------------------------------------------------------------------------------
def rollup_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Tumbling hourly counts; a partial aggregate precedes the exchange on the key."""
    use_rocksdb(events.sparkSession)
    return (events.withWatermark("received_at", watermark)
            .groupBy(F.window("received_at", "1 hour").alias("_w"), "group_id")
            .agg(F.count(F.lit(1)).alias("event_count"))
            .select("group_id", F.col("_w.start").alias("bucket_start"), "event_count"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 available_now: bool = True, name: str | None = None) -> StreamingQuery:
    writer = (df.writeStream.format("parquet").outputMode(mode)
              .option("path", path).option("checkpointLocation", checkpoint))
    if name is not None:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def maintain_rollups(events: DataFrame, root: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    """Keep the rollups current at every width, with no waiting for a watermark.

    Each batch is reduced to (group, hour) counts and merged into the days it touches; a batch
    that runs again is known by its id, so counts never double. Days stay compact, a reader has one
    version of each table, and what no version names any more is deleted.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        pyramid = Pyramid(df.sparkSession, f"{root}/rollups")
        pyramid.merge(cut(ingest.rollup(df)), "stream", batch_id)
        for table in pyramid.tables.values():
            table.vacuum()

    writer = (events.writeStream.foreachBatch(batch)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_maintained_rollups(spark: SparkSession, root: str, **window) -> DataFrame:
    return Pyramid(spark, f"{root}/rollups").read(**window)


# -- J4 -------------------------------------------------------------------------------------------
SILENCE_SCHEMA = T.StructType([
    T.StructField("group_id", T.StringType()),
    T.StructField("sweep_at", T.TimestampType()),
    T.StructField("busy_hours", T.IntegerType()),
])
_HOURS_SCHEMA = T.StructType([T.StructField("hour", T.LongType())])
HOUR_MS = 3_600_000


class SilenceProcessor(StatefulProcessor):
    """Per group: its active hours of the last window, and one timer per quiet spell.

    The state is a window's worth of hour numbers. An active hour asks to be looked at once
    it could first count as quiet; from there the look moves on hour by hour until the
    group speaks again or has too few busy hours left. Timers run in event time, so a group
    is found quiet when the watermark says so, with no sweep from outside.
    """

    def __init__(self, params: Params):
        self.window = params.silence_window_hours
        self.quiet = params.silence_quiet_hours
        self.busy = params.silence_min_busy_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", _HOURS_SCHEMA, _HOURS_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hours = sorted({int(h) for part in rows for h in part["hour"].unique()})
        for hour, after in zip(hours, [*hours[1:], None]):
            self.hours.updateValue((hour,), (hour,))
            # An hour followed closely by another one starts no quiet spell.
            if after is None or after - hour >= self.quiet:
                self.handle.registerTimer((hour + self.quiet) * HOUR_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sweep = expiredTimerInfo.getExpiryTimeInMs() // HOUR_MS
        now = timerValues.getCurrentWatermarkInMs() // HOUR_MS
        known = sorted(k[0] for k in self.hours.keys())
        for hour in known:
            if hour <= sweep - self.window:
                self.hours.removeKey((hour,))
        found = []
        while True:
            seen = [h for h in known if sweep - self.window < h < sweep]
            if len(seen) < self.busy or seen[-1] > sweep - self.quiet:
                break
            if sweep > now:
                self.handle.registerTimer(sweep * HOUR_MS)
                break
            found.append((key[0], pd.Timestamp(sweep * HOUR_MS, unit="ms"), len(seen)))
            sweep += 1
        yield pd.DataFrame(found, columns=["group_id", "sweep_at", "busy_hours"]
                           ) if found else pd.DataFrame()

    def close(self) -> None:
        pass


def silence_stream(events: DataFrame, watermark: str = "10 minutes",
                   params: Params = DEFAULTS) -> DataFrame:
    """Quiet groups as they fall quiet: (group_id, sweep_at, busy_hours).

    Events first shrink to one row per group and active hour (partial aggregation ahead
    of the exchange), so a busy group reaches its state as one row per hour.
    """
    use_rocksdb(events.sparkSession)
    active = (events.withWatermark("received_at", watermark)
              .groupBy(F.window("received_at", "1 hour").alias("_w"), "group_id")
              .agg(F.count(F.lit(1)).alias("_n"))
              .select("group_id", F.col("_w.start").alias("hour_at"),
                      F.floor(F.unix_seconds(F.col("_w.start")) / 3600).alias("hour"),
                      F.window_time("_w").alias("closes_at")))
    return (active.groupBy("group_id")
            .transformWithStateInPandas(
                statefulProcessor=SilenceProcessor(params), outputStructType=SILENCE_SCHEMA,
                outputMode="Append", timeMode="EventTime"))


def outcome_counts() -> list[Column]:
    """Metrics for ``df.observe`` (B16): what a batch accepted or rejected."""
    ok = F.col("error").isNull()
    return [F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected")]
