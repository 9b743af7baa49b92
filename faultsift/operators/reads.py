"""Dashboard reads over groups and rollups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.sources.versions import VersionedTable

OVERVIEW_DAYS = {"7d": 7, "30d": 30}
CLOCK = "yyyy-MM-dd HH:mm:ss"


def matching(groups: DataFrame, service: str | None = None, status: str | None = None,
             q: str | None = None) -> DataFrame:
    """Filters that are absent add nothing to the plan."""
    if service:
        groups = groups.filter(F.col("service") == service)
    if status:
        groups = groups.filter(F.col("status") == status)
    if q:
        # A backslash stands for itself; % and _ stay wildcards.
        escaped = q.replace("\\", "\\\\")
        groups = groups.filter(F.col("title").ilike(f"%{escaped}%"))
    return groups


# -- H1 ---------------------------------------------------------------------------------------------
def keyset_page(rows: DataFrame, at: str, key: str, limit: int,
                after: tuple | None = None) -> DataFrame:
    """One page, newest first, plus one row whose presence means there is a next page.

    The plain range on the leading column is implied by the pair comparison, but only the
    plain one reaches the Parquet reader.
    """
    if after is not None:
        seen, last_key = (F.lit(v) for v in after)
        rows = rows.filter(F.col(at) <= seen).filter(
            (F.col(at) < seen) | (F.col(key) < last_key))
    return rows.orderBy(F.desc(at), F.desc(key)).limit(limit + 1)


def newest_page(table: VersionedTable, at: str, key: str, limit: int, after: tuple | None = None,
                where: Column | None = None) -> DataFrame:
    """The same page of a written table of days: days are opened from the newest, twice as many each time,
    until the page is full of rows newer than all that is left. The manifest says where to begin and stop."""
    manifest = table.manifest()
    bound = None if after is None else str(after[0])
    days = sorted(((p.high, v, p.rows) for v, p in manifest.parts.items() if bound is None or p.low <= bound), reverse=True)
    opened, expected = 0, 0
    while opened < len(days) and expected <= limit:
        expected += days[opened][2]
        opened += 1
    while True:
        names = {v for _, v, _ in days[:opened]}
        rows = table.read(lambda v, _, names=names: v in names, manifest)
        page = keyset_page(rows if where is None else rows.filter(where), at, key, limit, after)
        if opened >= len(days):
            return page
        full = page.agg(F.count(F.lit(1)), F.min(at).cast("string")).first()
        if full[0] == limit + 1 and full[1] > days[opened][0]:
            return page
        opened *= 2


def group_page(groups: DataFrame, limit: int, after: tuple | None = None, **filters) -> DataFrame:
    page = matching(groups, **filters).select(
        "group_id", "title", "service", "platform", "level", "status", "culprit",
        "degraded_reason", "event_count", "first_seen", "last_seen")
    return keyset_page(page, "last_seen", "group_id", limit, after)


# -- H2, H5 --------------------------------------------------------------------------------------------
def counts_by_status(groups: DataFrame, service: str | None = None,
                     q: str | None = None) -> DataFrame:
    return matching(groups, service, None, q).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def list_services(groups: DataFrame) -> DataFrame:
    return groups.select("service").distinct().orderBy("service")


# -- spines ---------------------------------------------------------------------------------------------
def spine(spark: SparkSession, end: dt.datetime, steps: int, unit: str) -> DataFrame:
    """``steps`` consecutive days or hours ending with the one that holds ``end``."""
    last = F.date_trunc(unit, F.lit(end).cast("timestamp"))
    every = F.expr(f"interval 1 {unit}")
    start = last - (F.make_interval(days=F.lit(steps - 1)) if unit == "day"
                    else F.make_interval(hours=F.lit(steps - 1)))
    return spark.range(1).select(F.explode(F.sequence(start, last, every)).alias("bucket"))


def zero_filled(rollups: DataFrame, end: dt.datetime, steps: int, unit: str,
                at: str = "bucket_start", count: str = "event_count") -> DataFrame:
    """Totals per day or hour over the window, quiet ones as zero.

    The range filter on the bare column prunes; the aggregate shrinks the data to the
    spine's size; the spine is then an equi-join.
    """
    last = F.date_trunc(unit, F.lit(end).cast("timestamp"))
    width = F.make_interval(days=F.lit(1)) if unit == "day" else F.make_interval(hours=F.lit(1))
    back = (F.make_interval(days=F.lit(steps - 1)) if unit == "day"
            else F.make_interval(hours=F.lit(steps - 1)))
    totals = (rollups.filter((F.col(at) >= last - back) & (F.col(at) < last + width))
              .groupBy(F.date_trunc(unit, F.col(at)).alias("bucket"))
              .agg(F.sum(count).alias("_n")))
    return (spine(rollups.sparkSession, end, steps, unit).join(totals, "bucket", "left")
            .select("bucket", F.coalesce("_n", F.lit(0)).cast("bigint").alias("event_count")))


# -- H3, H4 ------------------------------------------------------------------------------------------------
def overview_trend(rollups: DataFrame, groups: DataFrame, as_of: dt.datetime, window: str = "7d",
                   **filters) -> DataFrame:
    """Daily totals over every group the filters select."""
    chosen = rollups
    if any(filters.values()):
        ids = matching(groups, **filters).select("group_id")
        chosen = rollups.join(ids, "group_id", "left_semi")
    return zero_filled(chosen, as_of, OVERVIEW_DAYS[window], "day").withColumnRenamed(
        "bucket", "day")


def widened_overview(rollups: DataFrame, groups: DataFrame, events: DataFrame,
                     as_of: dt.datetime, asked: str | None = None, **filters) -> DataFrame:
    """Seven days, or thirty when no range was asked for, the seven are empty and events are stored.

    Both windows come from one pass; the choice is a column, not a second query.
    """
    daily = overview_trend(rollups, groups, as_of, "30d", **filters)
    week = F.date_trunc("day", F.lit(as_of).cast("timestamp")) - F.make_interval(days=F.lit(6))
    totals = daily.agg(
        F.sum(F.when(F.col("day") >= week, F.col("event_count"))).alias("_week"))
    stored = events.select(F.lit(1)).limit(1).agg(F.count(F.lit(1)).alias("_stored"))
    if asked is not None:
        wide = F.lit(asked == "30d")
    else:
        wide = (F.col("_week") == 0) & (F.col("_stored") > 0)
    one = F.lit(1)
    return (daily.withColumn("_one", one)
            .join(totals.withColumn("_one", one), "_one")
            .join(stored.withColumn("_one", one), "_one")
            .withColumn("window", F.when(wide, "30d").otherwise("7d"))
            .filter((F.col("window") == "30d") | (F.col("day") >= week))
            .select("day", "event_count", "window"))


# -- H6 ---------------------------------------------------------------------------------------------------------
def sparklines(rollups: DataFrame, as_of: dt.datetime, ids: DataFrame | None = None) -> DataFrame:
    """Last seven daily counts per group as a zero-filled array, oldest first."""
    today = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    week = rollups.filter(F.col("bucket_start") >= today - F.make_interval(days=F.lit(6)))
    if ids is not None:
        week = week.join(ids.select("group_id"), "group_id", "left_semi")
    ago = F.datediff(today, F.col("bucket_start"))
    days = [F.coalesce(F.sum(F.when(ago == i, F.col("event_count"))), F.lit(0))
            for i in range(6, -1, -1)]
    return week.groupBy("group_id").agg(F.array(*days).alias("daily"))


# -- H7 -----------------------------------------------------------------------------------------------------------
def group_detail(groups: DataFrame, events: DataFrame, group_id: str | None = None) -> DataFrame:
    """Every group, or one, with its newest traced event and its release range.

    The newest position of each group is found on the narrow columns; only the winners' messages and
    traces are joined to it.
    """
    if group_id is not None:
        groups, events = (df.filter(F.col("group_id") == group_id) for df in (groups, events))
    traced = events.filter(F.col("stacktrace").isNotNull())
    last = traced.groupBy("group_id").agg(
        F.max(F.struct("received_at", "event_id")).alias("_p")).select(
        "group_id", "_p.received_at", "_p.event_id")
    newest = traced.join(last, ["group_id", "received_at", "event_id"]).select(
        "group_id", F.col("message").alias("sample_message"),
        F.col("stacktrace").alias("sample_stacktrace"),
        F.col("received_at").alias("sample_received_at"))
    releases = F.when(F.col("release_first").eqNullSafe(F.col("release_last")),
                      F.col("release_first")).otherwise(
        F.concat_ws(" → ", "release_first", "release_last"))
    return (groups.withColumn("release_range", releases).join(newest, "group_id", "left"))


# -- H8 ---------------------------------------------------------------------------------------------------------------
def group_series(rollups: DataFrame, group_id: str, as_of: dt.datetime,
                 window: str = "24h") -> DataFrame:
    """One group's zero-filled trend: 24 hours, 7 days or 30 days."""
    own = rollups.filter(F.col("group_id") == group_id)
    if window == "24h":
        steps, unit, label = 24, "hour", "HH:mm"
    else:
        steps, unit, label = OVERVIEW_DAYS[window], "day", "dd MMM"
    return zero_filled(own, as_of, steps, unit).select(
        F.date_format("bucket", label).alias("label"),
        F.date_format("bucket", CLOCK).alias("iso"), "event_count")


# -- H11, H12 ---------------------------------------------------------------------------------------------------------
def nav_counts(groups: DataFrame, alerts: DataFrame) -> DataFrame:
    open_groups = groups.agg(
        F.count_if(F.col("status").isin("open", "regressed")).alias("open_groups"))
    total = alerts.agg(F.count(F.lit(1)).alias("alerts"))
    one = F.lit(1)
    return (open_groups.withColumn("_one", one).join(total.withColumn("_one", one), "_one")
            .drop("_one"))


def storage_status(events: DataFrame, rollups: DataFrame, sweeps: DataFrame,
                   sizes: dict[str, int] | None = None) -> DataFrame:
    """Row counts, event time range and the last sweep; nulls where nothing ran.

    ``sizes`` adds stored bytes, such as ``{"events_bytes": sinks.table_bytes(…)}``.
    """
    e = events.agg(F.count(F.lit(1)).alias("event_rows"),
                   F.date_format(F.min("received_at"), CLOCK).alias("oldest_event"),
                   F.date_format(F.max("received_at"), CLOCK).alias("newest_event"))
    r = rollups.agg(F.count(F.lit(1)).alias("rollup_rows"))
    s = sweeps.agg(F.max_by(F.struct(
        F.date_format("ran_at", CLOCK).alias("last_sweep_at"),
        F.col("source").alias("last_sweep_source"),
        F.col("window_days").alias("last_sweep_window_days"),
        F.col("deleted_events").alias("last_sweep_deleted")), "ran_at").alias("_s"))
    one = F.lit(1)
    return (e.withColumn("_one", one).join(r.withColumn("_one", one), "_one")
            .join(s.withColumn("_one", one), "_one").select("*", "_s.*").drop("_one", "_s")
            .withColumns({name: F.lit(size).cast("bigint") for name, size in (sizes or {}).items()}))


# -- H13 -----------------------------------------------------------------------------------------------------------------
def trend_summary(rollups: DataFrame, *keys: str, at: str = "bucket_start") -> DataFrame:
    """Total, peak and first instant of the peak per key."""
    peak_order = F.struct(-F.col("event_count"), F.col(at))
    return rollups.groupBy(*keys).agg(
        F.sum("event_count").alias("total"), F.max("event_count").alias("peak"),
        F.min_by(at, peak_order).alias("first_peak_at"))
