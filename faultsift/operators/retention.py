"""Adaptive retention of raw events; rollups and groups are never touched."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, Params
from faultsift.sources.versions import VersionedTable


# -- G1 -------------------------------------------------------------------------------------------
def window_days(size: Column, params: Params = DEFAULTS) -> Column:
    """Days to keep at a given stored size: shorter under pressure."""
    return (F.when(size >= params.critical_bytes, params.critical_days)
            .when(size >= params.pressure_bytes, params.pressure_days)
            .otherwise(params.retention_days))


def stored_bytes(events: DataFrame, columns: list[str]) -> DataFrame:
    """Size of the stored text, for stores that cannot report their own."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return events.agg(F.sum(size.cast("bigint")).alias("events_bytes"))


# -- G2 -------------------------------------------------------------------------------------------
def expired(events: DataFrame, as_of: Column, days: Column, limit: int | None = None,
            at: str = "received_at", key: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Events past the window; with ``limit``, the oldest of them, for a bounded delete."""
    old = events.filter(F.col(at) < as_of - F.make_interval(days=days))
    return old if limit is None else old.orderBy(at, *key).limit(limit)


def survivors(events: DataFrame, as_of: Column, days: Column, limit: int | None = None,
              at: str = "received_at", key: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """What a sweep leaves. Unbounded, it is a range filter that prunes date folders."""
    if limit is None:
        return events.filter(F.col(at) >= as_of - F.make_interval(days=days))
    gone = expired(events, as_of, days, limit, at, key).select(*key)
    return events.join(gone, list(key), "left_anti")


# -- G3 -------------------------------------------------------------------------------------------
def sweep_record(deleted: DataFrame, source: str, days: int, size: int,
                 ran_at: dt.datetime) -> DataFrame:
    """One audit row per sweep."""
    return deleted.agg(F.count(F.lit(1)).alias("deleted_events")).select(
        F.lit(ran_at).cast("timestamp").alias("ran_at"), F.lit(source).alias("source"),
        F.lit(days).alias("window_days"), "deleted_events",
        F.lit(size).cast("bigint").alias("events_bytes"))


TEXT_COLUMNS = ["message", "stacktrace", "payload"]


def sweep(events: DataFrame, ran_at: dt.datetime, source: str = "scheduled", size: int | None = None,
          params: Params = DEFAULTS, limit: int | None = None, days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events that stay, audit record) of one sweep: the stored size sets the window unless ``days`` does, events
    past it go, at most ``limit`` of them, and the record says so. Without ``size`` the stored text is summed."""
    if size is None:
        size = stored_bytes(events, TEXT_COLUMNS).first()[0] or 0
    if days is None:
        days = (params.critical_days if size >= params.critical_bytes else
                params.pressure_days if size >= params.pressure_bytes else params.retention_days)
    at = F.lit(ran_at).cast("timestamp")
    gone = expired(events, at, F.lit(days), limit)
    return (survivors(events, at, F.lit(days), limit),
            sweep_record(gone, source, days, size, ran_at))


def sweep_table(table: VersionedTable, ran_at: dt.datetime, source: str = "scheduled", size: int | None = None,
                params: Params = DEFAULTS, limit: int | None = None, days: int | None = None) -> DataFrame:
    """The same sweep on a written table of days; returns the record.

    Days wholly past the window go by the manifest alone, oldest first; only the day in which the window (or
    the limit) ends is read and written anew. Without ``size`` the file listing is asked.
    """
    if size is None:
        size = table.stored_bytes()
    if days is None:
        days = (params.critical_days if size >= params.critical_bytes else
                params.pressure_days if size >= params.pressure_bytes else params.retention_days)
    end, left = ran_at - dt.timedelta(days=days), limit
    manifest = table.manifest()
    old = sorted((dt.datetime.fromisoformat(p.low), v, p) for v, p in manifest.parts.items()
                 if dt.datetime.fromisoformat(p.low) < end)
    whole, deleted, edge = [], 0, None
    for _, value, part in old:
        if dt.datetime.fromisoformat(part.high) >= end or (left is not None and part.rows > left):
            edge = (value, part)
            break
        whole.append(value)
        deleted += part.rows
        left = None if left is None else left - part.rows
    if edge is None or left == 0:
        if whole:
            table.replace(table.read(lambda *_: False), touched=[], drop=whole)
    else:
        value, part = edge
        day = table.read(lambda v, _: v == value)
        kept = survivors(day, F.lit(ran_at).cast("timestamp"), F.lit(days), left).select(*day.columns)
        after = table.replace(kept, touched=[value], drop=whole)
        deleted += part.rows - (after.parts[value].rows if value in after.parts else 0)
    return table.spark.createDataFrame(
        [(ran_at, source, days, deleted, size)],
        "ran_at timestamp, source string, window_days int, deleted_events bigint, events_bytes bigint")


def sweep_metrics(raised: DataFrame, deleted: DataFrame, scored: DataFrame) -> DataFrame:
    """Counters of one sweep: silence alerts raised, events deleted, verdicts scored."""
    one = F.lit(1)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(one).alias(name)).withColumn("_one", one)

    return (counted(raised, "alerted").join(counted(deleted, "deleted"), "_one")
            .join(counted(scored, "scored"), "_one").drop("_one"))


# -- G4 -------------------------------------------------------------------------------------------
def trend_loss(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rollup buckets that a sweep changed; must be empty."""
    keys = ["group_id", "bucket_start"]
    return (before.join(after.withColumnRenamed("event_count", "after_count"), keys, "full_outer")
            .filter(~F.col("event_count").eqNullSafe(F.col("after_count"))))
