"""Table jobs over fingerprints: frames, message templates, version replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.functions.fingerprint import with_fingerprint
from faultsift.functions.text import normalize_message

REPLAY_LIMIT_MAX = 50_000


# -- C2 -------------------------------------------------------------------------------------------
def message_templates(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """Distinct normalised messages per key with how many originals each stands for."""
    return (texts.select(*keys, normalize_message(F.col(text)).alias("template"))
            .groupBy(*keys, "template").agg(F.count(F.lit(1)).alias("events")))


# -- C5 to C10 ---------------------------------------------------------------------------------------
def frames_table(events: DataFrame) -> DataFrame:
    """One row per frame, in trace order."""
    return (events.select("event_id", "group_id", "resolved_platform",
                          F.posexplode("frames").alias("position", "_f"))
            .select("event_id", "group_id", "resolved_platform", "position", "_f.*"))


# -- C24 ----------------------------------------------------------------------------------------------
def frame_counts(groups: DataFrame) -> DataFrame:
    """In-app and vendor frames of each group's first event."""
    own = F.size(F.filter("frames", lambda f: f["in_app"]))
    return groups.select("group_id", own.alias("in_app_frames"),
                         (F.size("frames") - own).alias("vendor_frames"))


# -- C21 to C23 -----------------------------------------------------------------------------------------
def replay(events: DataFrame, version: int, limit: int | None = None) -> DataFrame:
    """Candidate fingerprints of stored traced events: (group_id, candidate, events).

    The whole history by default; ``limit`` takes the newest events only, up to 50,000.
    """
    traced = events.filter(F.col("group_id").isNotNull() & F.col("stacktrace").isNotNull())
    if limit is not None:
        if not 1 <= limit <= REPLAY_LIMIT_MAX:
            raise ValueError(f"limit must be between 1 and {REPLAY_LIMIT_MAX}")
        traced = traced.orderBy(F.desc("received_at"), F.desc("event_id")).limit(limit)
    # The stored platform is the resolved one, and counts as declared.
    inputs = traced.select(
        F.col("group_id").alias("current_group"), "service",
        F.col("resolved_platform").alias("platform"), "exception_type", "message", "stacktrace")
    return (with_fingerprint(inputs, version)
            .groupBy(F.col("current_group").alias("group_id"),
                     F.col("fingerprint").alias("candidate"))
            .agg(F.count(F.lit(1)).alias("events")))


def replay_merges(mapping: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates that would absorb several groups, one row per absorbed group."""
    sizes = (mapping.groupBy("candidate").agg(F.count(F.lit(1)).alias("members"))
             .filter(F.col("members") > 1))
    return (mapping.select("candidate", "group_id").join(sizes, "candidate")
            .join(groups.select("group_id", "title"), "group_id", "left"))


def replay_splits(mapping: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups that would break into several fingerprints."""
    pieces = (mapping.groupBy("group_id").agg(F.count(F.lit(1)).alias("into"))
              .filter(F.col("into") > 1))
    return pieces.join(groups.select("group_id", "title"), "group_id", "left")


def replay_coverage(mapping: DataFrame, groups: DataFrame, version: int) -> DataFrame:
    covered = mapping.agg(F.countDistinct("group_id").alias("groups_covered"),
                          F.coalesce(F.sum("events"), F.lit(0)).alias("events_replayed"))
    # Two one-row aggregates side by side.
    return (groups.agg(F.count(F.lit(1)).alias("groups_total"))
            .withColumn("_one", F.lit(1))
            .join(covered.withColumn("_one", F.lit(1)), "_one").drop("_one")
            .withColumn("version", F.lit(version)))
