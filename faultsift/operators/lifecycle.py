"""Manual status changes, regressions, and the state of every group at an instant.

Events are reached through the hours they fall in: an hourly first/last table decides
which single hour matters to a status change, and only that hour's events are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faultsift.operators.ingest import hour_of


def hourly_bounds(events: DataFrame) -> DataFrame:
    return (events.groupBy("group_id", hour_of().alias("hour"))
            .agg(F.min("received_at").alias("min_at"), F.max("received_at").alias("max_at")))


def _on_time_line(points: DataFrame, hours: DataFrame, at: str) -> DataFrame:
    """Points and hours of a group on one time line (``_t``), an hour at its ``at`` and before equal
    points: what an as-of lookup sorts. A group has as many rows as hours and changes."""
    return (hours.select("group_id", F.col(at).alias("_t"), F.lit(0).alias("_turn"), "hour",
                         F.lit(None).cast("timestamp").alias("at"))
            .unionByName(points.select("group_id", F.col("at").alias("_t"), F.lit(1).alias("_turn"),
                                       F.lit(None).cast("timestamp").alias("hour"), "at")))


def _line(first: int, last: int) -> WindowSpec:
    return Window.partitionBy("group_id").orderBy("_t", "_turn").rowsBetween(first, last)


def first_event_after(events: DataFrame, points: DataFrame) -> DataFrame:
    """First event strictly after each (group_id, at): adds next_at, next_id, next_release.

    Its hour is the first whose last event is later than the point; only that hour's events are read.
    """
    target = (_on_time_line(points, hourly_bounds(events), "max_at")
              .select("group_id", "at", F.first("hour", ignorenulls=True)
                      .over(_line(Window.currentRow, Window.unboundedFollowing)).alias("hour"))
              .filter(F.col("at").isNotNull() & F.col("hour").isNotNull()))
    order = F.struct("received_at", "event_id")
    return (events.withColumn("hour", hour_of()).join(target, ["group_id", "hour"])
            .filter(F.col("received_at") > F.col("at"))
            .groupBy("group_id", "at")
            .agg(F.min_by(F.struct("received_at", "event_id", "release"), order).alias("_e"))
            .select("group_id", "at", F.col("_e.received_at").alias("next_at"),
                    F.col("_e.event_id").alias("next_id"),
                    F.col("_e.release").alias("next_release")))


def last_release_before(events: DataFrame, points: DataFrame) -> DataFrame:
    """Release of the last release-carrying event at or before each (group_id, at).

    Its hour is the last whose first event is not later than the point.
    """
    released = events.filter(F.col("release").isNotNull()).select(
        "group_id", "received_at", "event_id", "release")
    target = (_on_time_line(points, hourly_bounds(released), "min_at")
              .select("group_id", "at", F.last("hour", ignorenulls=True)
                      .over(_line(Window.unboundedPreceding, Window.currentRow)).alias("hour"))
              .filter(F.col("at").isNotNull() & F.col("hour").isNotNull()))
    return (released.withColumn("hour", hour_of()).join(target, ["group_id", "hour"])
            .filter(F.col("received_at") <= F.col("at"))
            .groupBy("group_id", "at")
            .agg(F.max_by("release", F.struct("received_at", "event_id")).alias("release_last_at")))


# -- D1 -------------------------------------------------------------------------------------------
def status_intervals(changes: DataFrame, groups: DataFrame, events: DataFrame) -> DataFrame:
    """Status changes as intervals [changed_at, until), with the release resolved in.

    Changes to unknown groups are no-ops. A resolve without a release takes the group's
    last release at that time.
    """
    known = changes.join(groups.select("group_id"), "group_id", "left_semi")
    w = Window.partitionBy("group_id").orderBy("changed_at")
    spans = known.withColumn("until", F.lead("changed_at").over(w))
    points = (spans.filter((F.col("status") == "resolved") & F.col("release").isNull())
              .select("group_id", F.col("changed_at").alias("at")))
    seen = last_release_before(events, points).withColumnRenamed("at", "changed_at")
    resolved = F.col("status") == "resolved"
    return (spans.join(seen, ["group_id", "changed_at"], "left")
            .withColumn("resolved_at", F.when(resolved, F.col("changed_at")))
            .withColumn("resolved_in_release",
                        F.when(resolved, F.coalesce("release", "release_last_at")))
            .drop("release_last_at", "release"))


# -- D2 --------------------------------------------------------------------------------------------
def regressions(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """The first event inside each resolved interval: it brought the group back."""
    resolved = intervals.filter(F.col("status") == "resolved")
    points = resolved.select("group_id", F.col("changed_at").alias("at"))
    following = first_event_after(events, points).withColumnRenamed("at", "changed_at")
    return (resolved.select("group_id", "changed_at", "until")
            .join(following, ["group_id", "changed_at"])
            .filter(F.col("until").isNull() | (F.col("next_at") < F.col("until")))
            .select("group_id", "changed_at", F.col("next_at").alias("regressed_at"),
                    F.col("next_release").alias("regressed_in_release"),
                    F.col("next_id").alias("regressed_event_id")))


# -- D3 --------------------------------------------------------------------------------------------
def group_states(groups: DataFrame, intervals: DataFrame, comebacks: DataFrame,
                 as_of: Column) -> DataFrame:
    """Status and lifecycle stamps of every group at ``as_of``."""
    latest = (intervals.filter(F.col("changed_at") <= as_of)
              .groupBy("group_id")
              .agg(F.max_by(F.struct("status", "changed_at", "resolved_at",
                                     "resolved_in_release"), "changed_at").alias("_s"))
              .select("group_id", "_s.*"))
    back = comebacks.filter(F.col("regressed_at") <= as_of).drop("regressed_event_id")
    state = (latest.join(back, ["group_id", "changed_at"], "left")
             .withColumn("status", F.when(F.col("regressed_at").isNotNull(), F.lit("regressed"))
                         .otherwise(F.col("status")))
             .drop("changed_at"))
    return (groups.drop("status").join(state, "group_id", "left")
            .withColumn("status", F.coalesce("status", F.lit("open"))))


def status_timeline(intervals: DataFrame, comebacks: DataFrame) -> DataFrame:
    """(group_id, status, since, until) pieces, a regression splitting its interval."""
    joined = intervals.select("group_id", "changed_at", "until", "status").join(
        comebacks.select("group_id", "changed_at", "regressed_at"),
        ["group_id", "changed_at"], "left")
    pieces = F.when(F.col("regressed_at").isNull(), F.array(
        F.struct(F.col("status").alias("status"), F.col("changed_at").alias("since"),
                 F.col("until").alias("until")))
    ).otherwise(F.array(
        F.struct(F.col("status").alias("status"), F.col("changed_at").alias("since"),
                 F.col("regressed_at").alias("until")),
        F.struct(F.lit("regressed").alias("status"), F.col("regressed_at").alias("since"),
                 F.col("until").alias("until"))))
    return joined.select("group_id", F.explode(pieces).alias("_p")).select("group_id", "_p.*")


# -- D4 ---------------------------------------------------------------------------------------------
def triage_list(groups: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Newest groups first, optionally of one status; 1 to 500 rows."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    chosen = groups if status is None else groups.filter(F.col("status") == status)
    return (chosen.select("group_id", "service", "title", "status", "event_count", "last_seen")
            .orderBy(F.desc("last_seen"), F.desc("group_id")).limit(limit))
