"""Validation, legacy fields, de-duplication, rollups, groups, the hourly cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, Params
from faultsift.functions import text as tx
from faultsift.functions.fingerprint import with_fingerprint
from faultsift.operators.ranks import locate_nth

# ---- fixed values: wire field, column, longest accepted value, must it be present ----
FIELD_RULES = (
    ("service", "service", 100, True),
    ("level", "level", 20, True),
    ("message", "message", 4000, True),
    ("platform", "platform", 50, False),
    ("exceptionType", "exception_type", 500, False),
    ("stacktrace", "stacktrace", 20000, False),
    ("release", "release", 100, False),
)
CAPTURE_LIMITS = {"message": 4000, "stacktrace": 20000}
# ---------------------------------------------------------------------------------------

HOUR_US = 3_600_000_000


def hour_of(column: str = "received_at") -> Column:
    return F.date_trunc("hour", F.col(column))


# -- B4: cut at capture ---------------------------------------------------------------------
def truncate_at_capture(df: DataFrame) -> DataFrame:
    return df.withColumns({c: tx.truncate(F.col(c), n) for c, n in CAPTURE_LIMITS.items()})


# -- B1: validation -------------------------------------------------------------------------
def violation() -> Column:
    """The first broken rule in text order, or null for a valid event."""
    broken = []
    for field, column, limit, required in FIELD_RULES:
        c = F.col(column)
        if required:
            broken.append(F.when(tx.is_blank(c), F.lit(f"{field} must not be blank")))
        broken.append(F.when(tx.utf16_longer_than(c, limit),
                             F.lit(f"{field} size must be between 0 and {limit}")))
    return F.array_min(F.array(*broken))


def validate(df: DataFrame) -> DataFrame:
    return df.withColumn("error", violation())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate(df)
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


# -- B2, B3: legacy payload fields ------------------------------------------------------------
def _payload_field(name: str) -> Column:
    return F.try_variant_get(F.try_parse_json("payload"), f"$.{name}", "variant")


def _payload_string(name: str) -> Column:
    node = _payload_field(name)
    return F.when(F.schema_of_variant(node) == "STRING",
                  F.try_variant_get(F.try_parse_json("payload"), f"$.{name}", "string"))


def _payload_trace() -> Column:
    lines = F.from_json(F.get_json_object("payload", "$.stacktrace"), "array<string>")
    texts = F.transform(lines, lambda l: F.coalesce(l, F.lit("null")))
    # A newline joins two parts only once something has been written.
    first = F.array_position(F.transform(texts, lambda l: l != ""), True)
    written = F.slice(texts, F.greatest(first, F.lit(1)).cast("int"), F.size(texts))
    joined = F.nullif(F.array_join(written, "\n"), F.lit(""))
    kind = F.schema_of_variant(_payload_field("stacktrace"))
    return (F.when(kind == "STRING", F.get_json_object("payload", "$.stacktrace"))
            .when(kind.startswith("ARRAY"), F.when(first > 0, joined)))


def resolve_legacy(df: DataFrame) -> DataFrame:
    """Blank top-level fields fall back to the payload; JSON is parsed only for those."""
    def or_else(column: str, fallback: Column) -> Column:
        c = F.col(column)
        return F.when(~tx.is_blank(c), c).when(F.col("payload").isNotNull(), fallback)

    return df.withColumns({
        "exception_type": or_else("exception_type", _payload_string("exceptionType")),
        "release": or_else("release", _payload_string("release")),
        "stacktrace": or_else("stacktrace", _payload_trace()),
    })


# -- B5, B6: identity ---------------------------------------------------------------------------
def assign_event_ids(df: DataFrame) -> DataFrame:
    """Give id-less events a content-derived id, equal again when a task is retried."""
    content = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                      for c in ("service", "level", "message", "stacktrace",
                                                "payload")],
                          F.unix_micros("received_at").cast("string"))
    return df.withColumn("event_id", F.coalesce("event_id", F.sha2(content, 256)))


def deduplicate(df: DataFrame) -> DataFrame:
    """First arrival per event id.

    Written as a rank filter: Spark keeps one row per id in every map task
    (WindowGroupLimit) before the exchange, so copies never pile up in one reducer.
    """
    w = Window.partitionBy("event_id").orderBy("received_at", "seq")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def not_yet_stored(df: DataFrame, stored: DataFrame) -> DataFrame:
    return df.join(stored.select("event_id"), "event_id", "left_anti")


# -- raw feed to stored events -------------------------------------------------------------------
def accepted(raw: DataFrame) -> DataFrame:
    """Valid records, each id once, as they came: what ``store`` gives fingerprints to."""
    valid, _ = split_valid(assign_event_ids(raw))
    return deduplicate(valid)


def store(raw: DataFrame, params: Params = DEFAULTS,
          stored: DataFrame | None = None, by_day: bool = False) -> DataFrame:
    """Valid, de-duplicated, fingerprinted events; those that are not in ``stored``, if given.

    With ``by_day`` the raw records are laid out by day before their frames are read, for a write by day
    that shuffles nothing more.

    De-duplication shuffles the narrow raw record; fingerprinting follows it, so the
    frames are computed once per stored event and never shuffled.
    """
    fresh = accepted(raw)
    if stored is not None:
        fresh = not_yet_stored(fresh, stored)
    if by_day:
        fresh = fresh.withColumn("_day", F.to_date("received_at")).hint("rebalance", "_day").drop("_day")
    return with_fingerprint(resolve_legacy(fresh), params.fingerprint_version)


# -- B9, B10: rollups -------------------------------------------------------------------------------
def rollup(events: DataFrame) -> DataFrame:
    return (events.groupBy("group_id", hour_of().alias("bucket_start"))
            .agg(F.count(F.lit(1)).alias("event_count")))


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive upsert: counts of equal buckets add up."""
    return (old.unionByName(new).groupBy("group_id", "bucket_start")
            .agg(F.sum("event_count").alias("event_count")))


# -- B11: groups --------------------------------------------------------------------------------------
_FIRST_WINS = ["service", "platform", "exception_type", "title", "culprit",
               "fingerprint_input", "frames", "degraded_reason"]


def build_groups(events: DataFrame, cap: int = DEFAULTS.hourly_cap,
                 rollups: DataFrame | None = None) -> DataFrame:
    """One row per fault: descriptors of its first event, level of its last, counters.

    All aggregates are partial ones first: a map task sends one row per group it saw.
    """
    order = F.struct("received_at", "event_id")
    released = F.col("release").isNotNull()
    described = events.withColumn("platform", F.col("resolved_platform"))
    groups = described.groupBy("group_id", "fingerprint", "fingerprint_version").agg(
        F.min_by(F.struct(*_FIRST_WINS), order).alias("_first"),
        F.max_by("level", order).alias("level"),
        F.min("received_at").alias("first_seen"),
        F.max("received_at").alias("last_seen"),
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("release", F.when(released, order)).alias("release_first"),
        F.max_by("release", F.when(released, order)).alias("release_last"))
    counts = sampled_counts(rollup(events) if rollups is None else rollups, cap)
    return (groups.select("group_id", "fingerprint", "fingerprint_version", "_first.*", "level",
                          "first_seen", "last_seen", "event_count", "release_first",
                          "release_last")
            .join(counts, "group_id", "left")
            .withColumn("sampled_count", F.coalesce("sampled_count", F.lit(0))))


def merge_groups(old: DataFrame, new: DataFrame, rollups: DataFrame | None = None,
                 cap: int = DEFAULTS.hourly_cap) -> DataFrame:
    """Upsert of groups built from later events into the stored ones.

    What is known stays: descriptors, first sighting and first release are the stored ones'; level, last
    sighting and last release are the new ones'; counts add up. So nothing is lost when
    retention has deleted the events behind a stored group. ``rollups``, already merged, gives the
    sampled counts, as an hour may have begun in the old part.
    """
    part = F.col("_part")
    rows = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    merged = rows.groupBy("group_id", "fingerprint", "fingerprint_version").agg(
        F.min_by(F.struct(*_FIRST_WINS), part).alias("_first"), F.max_by("level", part).alias("level"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("event_count").alias("event_count"),
        F.min_by("release_first", F.when(F.col("release_first").isNotNull(), part)).alias("release_first"),
        F.max_by("release_last", F.when(F.col("release_last").isNotNull(), part)).alias("release_last"),
        F.sum("sampled_count").alias("_sampled"))
    merged = merged.select("group_id", "fingerprint", "fingerprint_version", "_first.*", "level",
                           "first_seen", "last_seen", "event_count", "release_first", "release_last",
                           F.col("_sampled").alias("sampled_count"))
    if rollups is None:
        return merged
    return (merged.drop("sampled_count").join(sampled_counts(rollups, cap), "group_id", "left")
            .withColumn("sampled_count", F.coalesce("sampled_count", F.lit(0))))


# -- B12 -----------------------------------------------------------------------------------------------
def with_group_age(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Whole hours between a group's first sighting and each of its events."""
    age = F.floor((F.unix_micros("received_at") - F.unix_micros("first_seen")) / HOUR_US)
    return (events.join(groups.select("group_id", "first_seen"), "group_id")
            .withColumn("age_hours", age.cast("int")))


# -- B13 -----------------------------------------------------------------------------------------------
def sampled_counts(rollups: DataFrame, cap: int) -> DataFrame:
    """Events past the cap per group: arithmetic over rollups, no event is touched."""
    over = F.greatest(F.col("event_count") - cap, F.lit(0))
    return rollups.groupBy("group_id").agg(F.sum(over).alias("sampled_count"))


def sampled_growth(before: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """(group_id, sampled_count): how many more events are past the cap once the hourly counts ``new`` are added to
    ``before``. Hours of ``before`` that nothing is added to need not be there."""
    def over(n: Column) -> Column:
        return F.greatest(n - cap, F.lit(0))

    was = F.coalesce("_was", F.lit(0))
    return (new.join(before.withColumnRenamed("event_count", "_was"), ["group_id", "bucket_start"], "left")
            .groupBy("group_id").agg(F.sum(over(was + F.col("event_count")) - over(was)).alias("sampled_count")))


def apply_hourly_cap(events: DataFrame, rollups: DataFrame, cap: int) -> DataFrame:
    """Past ``cap`` events in a group's hour, keep the count but drop trace and payload.

    Only the cap-th event of each full hour is located, by counting; every event is then compared
    with that one position, and events of other hours are not joined at all where Spark can
    tell. No window ever holds a whole hour of a busy group.
    """
    keys = ["group_id", "hour"]
    keyed = events.withColumn("hour", hour_of())
    full = rollups.filter(F.col("event_count") > cap).select(
        "group_id", F.col("bucket_start").alias("hour"), F.lit(cap).alias("n"))
    last_kept = locate_nth(keyed, full, keys).drop("n")
    # An hour that is not full has no limit (and a struct of nulls would compare as lowest).
    sampled = F.col("nth_at").isNotNull() & (
        F.struct("received_at", "event_id") > F.struct("nth_at", "nth_id"))
    return (keyed.join(last_kept, keys, "left")
            .withColumn("sampled", sampled)
            .withColumn("stacktrace", F.when(~F.col("sampled"), F.col("stacktrace")))
            .withColumn("payload", F.when(~F.col("sampled"), F.col("payload")))
            .drop("hour", "nth_at", "nth_id"))


# -- B7, B8, B16: receipts ------------------------------------------------------------------------------
def receipts(raw: DataFrame, events: DataFrame,
             regressions: DataFrame | None = None) -> DataFrame:
    """One outcome per delivered record: stored, duplicate or rejected with its reason.

    ``events`` is the stored table after the hourly cap; a delivery is the stored one when
    it carries the stored arrival's position. ``regressions`` (regressed_event_id) marks
    the events that brought a resolved group back. One equi-join on the id, with one row
    per id on the stored side, so AQE can split an id that was delivered very often.
    """
    checked = validate(assign_event_ids(raw)).select("event_id", "received_at", "seq", "error")
    kept = events.select(
        "event_id", F.col("received_at").alias("_at"), F.col("seq").alias("_seq"),
        "fingerprint", "group_id", "sampled")
    if regressions is not None:
        back = regressions.select(F.col("regressed_event_id").alias("event_id"),
                                  F.lit(True).alias("_back"))
        kept = kept.join(back, "event_id", "left")
    else:
        kept = kept.withColumn("_back", F.lit(False))
    stored = (F.col("error").isNull() & F.col("_at").isNotNull()
              & (F.col("received_at") == F.col("_at")) & (F.col("seq") == F.col("_seq")))

    def only_if_stored(value: str) -> Column:
        return F.when(F.col("stored"), F.col(value))

    return (checked.join(kept, "event_id", "left")
            .withColumn("stored", F.coalesce(stored, F.lit(False)))
            .select("event_id", "stored",
                    only_if_stored("fingerprint").alias("fingerprint"),
                    only_if_stored("group_id").alias("group_id"),
                    F.coalesce(only_if_stored("sampled"), F.lit(False)).alias("sampled"),
                    F.coalesce(only_if_stored("_back"), F.lit(False)).alias("regressed"),
                    "error",
                    # What a caller could have fixed is not worth sending again.
                    F.lit(False).alias("retryable")))


def receipt_summary(outcomes: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    return outcomes.agg(
        F.count(F.lit(1)).alias("accepted"),
        F.count_if("stored").alias("stored"),
        F.count_if(ok & ~F.col("stored")).alias("duplicates"),
        F.count_if(~ok).alias("failed"))


def outcome_metrics(outcomes: DataFrame) -> DataFrame:
    name = (F.when(F.col("error").isNotNull(), "rejected")
            .when(~F.col("stored"), "duplicate")
            .when(F.col("sampled"), "sampled").otherwise("stored"))
    return outcomes.groupBy(name.alias("outcome")).agg(F.count(F.lit(1)).alias("events"))


# -- B15 --------------------------------------------------------------------------------------------------
def reconcile_counts(groups: DataFrame, rollups: DataFrame) -> DataFrame:
    """Groups whose rollups do not add up to their counter; must be empty."""
    sums = rollups.groupBy("group_id").agg(F.sum("event_count").alias("rollup_count"))
    return (groups.select("group_id", "event_count").join(sums, "group_id", "full_outer")
            .filter(~F.col("event_count").eqNullSafe(F.col("rollup_count"))))


# -- A4, A5, A6: backfills ---------------------------------------------------------------------------------
def backfill_release(events: DataFrame) -> DataFrame:
    """Where the payload names a release, that one replaces the column."""
    from_payload = F.get_json_object("payload", "$.release")
    return events.withColumn("release", F.coalesce(from_payload, F.col("release")))


def drop_orphans(events: DataFrame) -> DataFrame:
    return events.filter(F.col("group_id").isNotNull())


def release_range(events: DataFrame) -> DataFrame:
    """First and last release seen per group, over events that carry one."""
    order = F.struct("received_at", "event_id")
    return (events.filter(F.col("release").isNotNull()).groupBy("group_id")
            .agg(F.min_by("release", order).alias("release_first"),
                 F.max_by("release", order).alias("release_last")))
