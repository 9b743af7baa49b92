"""Alert candidates, the cooldown between alerts, delivery state, queue and feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, Params
from faultsift.functions import series as sr
from faultsift.operators.detect import gone_quiet_sweeps, with_history
from faultsift.operators.ingest import HOUR_US, hour_of
from faultsift.operators.ranks import first_n, locate_nth
from faultsift.session import cut, scratch_path

KEYS = ["group_id", "kind"]
ERROR_LIMIT = 500


# -- F1 -------------------------------------------------------------------------------------------
SECOND_US = 1_000_000


def emit_with_cooldown(candidates: DataFrame, minutes: int,
                       previous: DataFrame | None = None) -> DataFrame:
    """Greedy suppression per (group_id, kind): keep a candidate when the last *kept* one
    is at least ``minutes`` older.

    ``candidates`` has group_id, kind, at, event_id; ``previous`` (group_id, kind, last_at)
    holds the last alerts already sent. A cooldown-wide time slot can keep at most one
    candidate, and only the slot right before can block it. So a slot that its predecessor
    cannot reach keeps its first candidate. In a run of touching slots every instant is linked to
    the first one a cooldown later; what is kept is what these links reach from the first instant,
    and doubling them finds it in log2(slots of the longest run) rounds. A busy group is never
    gathered in one task: links are made per second and slot, the rounds are joins.
    """
    width = minutes * 60_000_000
    at_us = F.unix_micros("at")
    cands = candidates.select(*KEYS, "event_id", at_us.alias("_us"))
    if previous is not None:
        # Alerts sent earlier block like a decided slot: drop what they still cover.
        cands = (cands.join(previous, KEYS, "left")
                 .filter(F.col("last_at").isNull()
                         | (F.col("_us") >= F.unix_micros("last_at") + width))
                 .drop("last_at"))
    # Of equal instants only the least id can be kept.
    nodes = cut(cands.groupBy(*KEYS, "_us").agg(F.min("event_id").alias("event_id"))
                .withColumn("_slot", F.floor(F.col("_us") / width)))
    by_slot = Window.partitionBy(*KEYS).orderBy("_slot")
    slots = nodes.groupBy(*KEYS, "_slot").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    touches = ((F.lag("_slot").over(by_slot) == F.col("_slot") - 1)
               & (F.lag("_hi").over(by_slot) + width > F.col("_lo")))
    # Slots of a run follow each other without a gap.
    slots = cut(slots.withColumn("_start", ~F.coalesce(touches, F.lit(False)))
                .withColumn("_run", F.max(F.when(F.col("_start"), F.col("_slot"))).over(by_slot))
                .withColumn("_after", F.lead("_run").over(by_slot))
                .withColumn("_after", F.coalesce(F.col("_after") == F.col("_run"), F.lit(False))).drop("_hi"))
    longest = slots.agg(F.max(F.col("_slot") - F.col("_run") + 1)).first()[0] or 0
    kept = slots.filter("_start AND NOT _after").select(*KEYS, F.col("_lo").alias("_us"))
    if longest > 1:
        kept = kept.unionByName(_reached(cut(_cooldown_links(nodes, slots, width)), longest))
    return (kept.join(nodes, [*KEYS, "_us"])
            .select(*KEYS, F.timestamp_micros("_us").alias("at"), "event_id"))


def _cooldown_links(nodes: DataFrame, slots: DataFrame, width: int) -> DataFrame:
    """(keys, _us, _next, _hit): each instant of a run of several slots whose successor, the first instant
    ``width`` or more later, lies in the run too; ``_hit`` marks the first instant of a run.

    What is looked for lies in the next slot: in the same second, else in the next second with any,
    else it is the first instant of the slot after that.
    """
    linked = slots.filter("_after").select(*KEYS, "_slot", F.col("_lo").alias("_first"), "_start")
    asked = nodes.join(linked, [*KEYS, "_slot"]).select(
        *KEYS, F.col("_us").alias("_from"), F.col("_start") & (F.col("_us") == F.col("_first")),
        (F.col("_us") + width).alias("_us")).toDF(*KEYS, "_from", "_hit", "_us")
    targets = nodes.join(slots.filter(~F.col("_start")).select(*KEYS, "_slot"), [*KEYS, "_slot"], "left_semi")
    null = F.lit(None)
    line = (asked.withColumn("_node", null.cast("bigint"))
            .unionByName(targets.select(*KEYS, null.cast("bigint").alias("_from"), null.cast("boolean").alias("_hit"),
                                        "_us", F.col("_us").alias("_node")))
            .withColumn("_second", F.floor(F.col("_us") / SECOND_US)))
    second = [*KEYS, "_second"]
    later = (Window.partitionBy(*second).orderBy("_us", F.asc_nulls_first("_node"))
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    here = line.withColumn("_here", F.first("_node", ignorenulls=True).over(later)).filter("_from IS NOT NULL")
    seconds = (line.groupBy(*second).agg(F.min("_node").alias("_least"))
               .withColumn("_slot", F.floor(F.col("_second") * SECOND_US / width)))
    rest = (Window.partitionBy(*KEYS, "_slot").orderBy("_second").rowsBetween(1, Window.unboundedFollowing))
    seconds = seconds.withColumn("_there", F.first("_least", ignorenulls=True).over(rest))
    beyond = slots.filter(~F.col("_start")).select(*KEYS, (F.col("_slot") - 1).alias("_slot"), F.col("_lo").alias("_beyond"))
    return (here.join(seconds.select(*second, "_there"), second)
            .withColumn("_slot", F.floor(F.col("_us") / width))
            .join(beyond, [*KEYS, "_slot"], "left")
            .select(*KEYS, F.col("_from").alias("_us"), F.coalesce("_here", "_there", "_beyond").alias("_next"), "_hit")
            .filter("_hit OR _next IS NOT NULL"))


def _reached(links: DataFrame, longest: int) -> DataFrame:
    """(keys, _us) that the links lead to from the marked instants. Each round marks what a marked one
    links to and doubles the length of all links, so after r rounds the first 2^r of a chain are marked."""
    for _ in range((longest - 1).bit_length()):
        live = links.filter("_next IS NOT NULL")
        hop = live.select(*KEYS, F.col("_us").alias("_next"), F.col("_next").alias("_far"))
        own = F.struct("_us", F.col("_far").alias("_next"), "_hit")
        mark = F.when(F.col("_hit"), F.struct(
            F.col("_next").alias("_us"), F.lit(None).cast("bigint").alias("_next"), F.lit(True).alias("_hit")))
        moved = (live.join(hop, [*KEYS, "_next"], "left")
                 .select(*KEYS, F.inline(F.array_compact(F.array(own, mark)))))
        links = cut(moved.unionByName(links.filter("_next IS NULL"))
                    .groupBy(*KEYS, "_us").agg(F.max("_next").alias("_next"), F.max("_hit").alias("_hit"))
                    .filter("_hit OR _next IS NOT NULL"))
    return links.filter("_hit").select(*KEYS, "_us")


def emit_on_hour_grid(candidates: DataFrame, minutes: int) -> DataFrame:
    """The same greedy choice for candidates on full hours, in one pass.

    A key has at most one candidate per calendar hour there, so its list stays short
    however many events it has, and folding over it inside the row is safe.
    """
    width = minutes * 60_000_000
    start = F.struct(F.lit(None).cast("bigint").alias("last"),
                     F.array().cast("array<bigint>").alias("kept"))

    def step(state: Column, at: Column) -> Column:
        free = state["last"].isNull() | (at >= state["last"] + width)
        return F.struct(F.when(free, at).otherwise(state["last"]).alias("last"),
                        F.when(free, F.array_append(state["kept"], at))
                        .otherwise(state["kept"]).alias("kept"))

    listed = candidates.groupBy(*KEYS).agg(
        F.array_sort(F.collect_set(F.unix_micros("at"))).alias("_all"))
    kept = F.aggregate("_all", start, step)["kept"]
    return listed.select(*KEYS, F.explode(kept).alias("_us")).select(
        *KEYS, F.timestamp_micros("_us").alias("at"), F.lit("").alias("event_id"))


# -- E8 --------------------------------------------------------------------------------------------
def firing_points(rollups: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Per bucket that fires by its end: the count n at which the active detector fires."""
    busy = with_history(rollups, params).filter(F.col("event_count") >= params.min_observed)
    return (sr.with_statistics(busy, "event_count", params)
            .select("group_id", F.col("bucket_start").alias("hour"), "history",
                    F.col("event_count").alias("size"),
                    F.explode(sr.first_firing_counts(F.col("event_count"), params)).alias("n")))


def spike_instants(events: DataFrame, points: DataFrame) -> DataFrame:
    """The first event of each firing bucket at which the detector fires."""
    keyed = events.withColumn("hour", hour_of())
    return locate_nth(keyed, points.select("group_id", "hour", "n"), ["group_id", "hour"])


def spike_candidates(events: DataFrame, instants: DataFrame) -> DataFrame:
    """From a bucket's first firing on, each of its events asks for an alert."""
    keyed = events.withColumn("hour", hour_of()).select(
        "group_id", "hour", "received_at", "event_id")
    return (keyed.join(instants, ["group_id", "hour"])
            .filter(F.struct("received_at", "event_id") >= F.struct("nth_at", "nth_id"))
            .select("group_id", F.lit("spike").alias("kind"), F.col("received_at").alias("at"),
                    "event_id"))


# -- E9 ---------------------------------------------------------------------------------------------
def new_group_candidates(events: DataFrame, groups: DataFrame,
                         params: Params = DEFAULTS) -> DataFrame:
    """Events of a young group from its threshold-th event on."""
    born = groups.select("group_id", "first_seen")
    age = F.floor((F.unix_micros("received_at") - F.unix_micros("first_seen")) / HOUR_US)
    young = (events.select("group_id", "received_at", "event_id").join(born, "group_id")
             .filter(age <= params.new_group_window_hours))
    threshold = (first_n(young, ["group_id"], params.new_group_threshold)
                 .filter(F.col("rank") == params.new_group_threshold)
                 .select("group_id", F.struct("received_at", "event_id").alias("_from")))
    return (young.join(threshold, "group_id")
            .filter(F.struct("received_at", "event_id") >= F.col("_from"))
            .select("group_id", F.lit("new_group").alias("kind"),
                    F.col("received_at").alias("at"), "event_id"))


def regression_candidates(comebacks: DataFrame) -> DataFrame:
    return comebacks.select("group_id", F.lit("regression").alias("kind"),
                            F.col("regressed_at").alias("at"),
                            F.col("regressed_event_id").alias("event_id"))


def silence_candidates(rollups: DataFrame, timeline: DataFrame, params: Params = DEFAULTS,
                       every_hours: int = 1) -> DataFrame:
    """Sweeps that find a watched group gone quiet; groups without changes are open."""
    sweeps = gone_quiet_sweeps(rollups, params, every_hours)
    # As-of lookup: sweeps and status spans on one time line per group, a span before equal sweeps.
    line = (sweeps.select("group_id", F.col("sweep_at").alias("_t"), F.lit(1).alias("_turn"),
                          F.lit(None).cast("struct<status:string,until:timestamp>").alias("_span"))
            .unionByName(timeline.select("group_id", F.col("since").alias("_t"), F.lit(0).alias("_turn"),
                                         F.struct("status", "until").alias("_span"))))
    before = (Window.partitionBy("group_id").orderBy("_t", "_turn", F.asc_nulls_last("_span.until"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (line.withColumn("_last", F.last("_span", ignorenulls=True).over(before))
            .filter("_turn = 1").withColumnRenamed("_t", "sweep_at")
            .withColumn("_status", F.when(
                F.col("_last.until").isNull() | (F.col("sweep_at") < F.col("_last.until")),
                F.col("_last.status")))
            .filter(F.coalesce("_status", F.lit("open")).isin("open", "regressed"))
            .select("group_id", F.lit("silence").alias("kind"), F.col("sweep_at").alias("at"),
                    F.lit("").alias("event_id")))


# -- F2 ---------------------------------------------------------------------------------------------
def raise_alerts(emitted: DataFrame, groups: DataFrame, spikes: DataFrame | None = None,
                 delivery: bool = True) -> DataFrame:
    """Alert rows of emitted candidates; ``spikes`` supplies the detection of the spike rows.

    The alert id is derived from what makes an alert unique, so a retry makes it again.
    """
    rows = emitted.select(
        "group_id", "kind", F.col("at").alias("created_at"), "event_id",
        F.date_trunc("hour", "at").alias("bucket_start"))
    if spikes is None:
        null = F.lit(None)
        rows = rows.withColumns({
            "detector": null.cast("string"), "observed": null.cast("bigint"),
            "baseline": null.cast("double"), "score": null.cast("double"),
            "threshold": null.cast("double")})
    else:
        rows = rows.join(spikes, ["group_id", "kind", "created_at", "event_id"], "left")
    return (rows.join(groups.select("group_id", "title"), "group_id")
            .withColumn("alert_id", F.substring(F.sha2(F.concat_ws(
                "|", "group_id", "kind", F.unix_micros("created_at").cast("string")), 256), 1, 32))
            .withColumn("delivery_state", F.lit("pending" if delivery else "disabled"))
            .drop("event_id"))


def spike_details(emitted: DataFrame, events: DataFrame, points: DataFrame,
                  params: Params = DEFAULTS) -> DataFrame:
    """The active detector's verdict at the moment each spike alert was emitted.

    ``observed`` is the hour's count up to that event, an aggregate over that one hour.
    """
    spikes = (emitted.filter(F.col("kind") == "spike")
              .select("group_id", F.col("at").alias("created_at"), "event_id",
                      F.date_trunc("hour", "at").alias("hour")))
    keyed = events.select("group_id", hour_of().alias("hour"), "received_at",
                          F.col("event_id").alias("_id"))
    seen = (keyed.join(spikes, ["group_id", "hour"])
            .filter(F.struct("received_at", "_id") <= F.struct("created_at", "event_id"))
            .groupBy("group_id", "hour", "created_at", "event_id")
            .agg(F.count(F.lit(1)).alias("_n")))
    judged = sr.with_statistics(
        seen.join(points.select("group_id", "hour", "history"), ["group_id", "hour"]), "_n", params)
    return (judged.withColumn("_v", sr.JUDGES[params.active_detector](F.col("_n"), params))
            .select("group_id", F.lit("spike").alias("kind"), "created_at", "event_id",
                    "_v.detector", "_v.observed", "_v.baseline", "_v.score", "_v.threshold"))


def all_alerts(events: DataFrame, rollups: DataFrame, groups: DataFrame, comebacks: DataFrame,
               timeline: DataFrame, params: Params = DEFAULTS, delivery: bool = True) -> DataFrame:
    """Every alert of the four kinds over the whole history."""
    points = cut(firing_points(rollups, params))  # few rows, read three times
    spikes = emit_with_cooldown(spike_candidates(events, spike_instants(events, points)),
                                params.cooldown_for("spike"))
    rules = emit_with_cooldown(
        new_group_candidates(events, groups, params).unionByName(regression_candidates(comebacks)),
        params.cooldown_for("new_group"))
    silences = emit_on_hour_grid(silence_candidates(rollups, timeline, params),
                                 params.cooldown_for("silence"))
    emitted = spikes.unionByName(rules).unionByName(silences)
    return raise_alerts(emitted, groups, spike_details(spikes, events, points, params), delivery)


# -- F3 -----------------------------------------------------------------------------------------------
def pending_queue(alerts: DataFrame, groups: DataFrame, limit: int | None = 20) -> DataFrame:
    """Undelivered alerts with the group facts a message needs, oldest first."""
    context = groups.select("group_id", "service", "culprit", "event_count", "status")
    queue = (alerts.filter(F.col("delivery_state") == "pending").join(context, "group_id")
             .select("alert_id", "group_id", "kind", "detector", "observed", "baseline", "score",
                     "title", "delivery_attempts", "created_at", "service", "culprit",
                     "event_count", "status")
             .orderBy("created_at", "alert_id"))
    return queue if limit is None else queue.limit(limit)


# -- F4 ------------------------------------------------------------------------------------------------
def fold_deliveries(alerts: DataFrame, attempts: DataFrame,
                    params: Params = DEFAULTS) -> DataFrame:
    """Delivery state from the attempt log (alert_id, attempted_at, ok, error).

    A drain stops after a success or after ``max_attempts`` failures; later entries do not
    count.
    """
    ok = F.col("ok")
    w = Window.partitionBy("alert_id").orderBy("attempted_at")
    tried = (attempts.withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") <= params.max_attempts).drop("_rn"))
    sent = tried.filter(ok).groupBy("alert_id").agg(F.min("attempted_at").alias("sent_at"))
    live = (tried.join(sent, "alert_id", "left")
            .filter(F.col("sent_at").isNull() | (F.col("attempted_at") <= F.col("sent_at"))))
    folded = live.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("delivery_attempts"),
        F.max(F.when(ok, F.col("attempted_at"))).alias("delivered_at"),
        F.max_by(F.struct("ok", F.substring(F.coalesce("error", F.lit("unknown")), 1, ERROR_LIMIT)
                          .alias("error")), "attempted_at").alias("_last"))
    state = (F.when(F.col("_last.ok"), "sent")
             .when(F.col("delivery_attempts") >= params.max_attempts, "failed")
             .when(F.col("delivery_attempts").isNotNull(), "pending")
             .otherwise(F.col("delivery_state")))
    return (alerts.join(folded, "alert_id", "left")
            .withColumn("delivery_state", state)
            .withColumn("delivery_attempts", F.coalesce("delivery_attempts", F.lit(0)))
            .withColumn("last_error", F.when(~F.col("_last.ok"), F.col("_last.error")))
            .drop("_last"))


# -- F5 --------------------------------------------------------------------------------------------------
def alert_feed(alerts: DataFrame, groups: DataFrame, limit: int = 50) -> DataFrame:
    """Newest alerts first, with their service; ties by id."""
    newest = [F.desc("created_at"), F.col("alert_id")]
    # Every alert has its group, so the newest can be taken before the join.
    return (alerts.orderBy(*newest).limit(limit)
            .join(groups.select("group_id", "service"), "group_id").orderBy(*newest))
