"""Hourly histories, detector verdicts, hindsight scoring, scorecard, backtest, silence.

Everything here works on rollups (one row per group and hour), never on events. A group
has at most one row per calendar hour, so a window over a group is bounded by the calendar,
however many events the group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, DETECTORS, Params
from faultsift.functions import series as sr

OUTCOMES = {"tp": "true_positive", "fp": "false_positive",
            "fn": "false_negative", "tn": "true_negative"}


def hour_number(c: Column) -> Column:
    return F.floor(F.unix_seconds(c) / 3600)


def dealt(rollups: DataFrame, key: str) -> DataFrame:
    """Rollups by key in as many parts as shuffles have. They are few bytes and much work, so AQE, which goes by
    bytes, would put them into one task; a number that is asked for is kept."""
    return rollups.repartition(int(rollups.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# -- E1, E2 -----------------------------------------------------------------------------------
def with_history(rollups: DataFrame, params: Params = DEFAULTS, key: str = "group_id",
                 first_seen: DataFrame | None = None) -> DataFrame:
    """Add ``history``: the dense hourly counts before each bucket, quiet hours as zero.

    It starts at the group's first hour and spans at most ``history_hours``. The non-empty
    neighbours come from one range window; zeros are filled in inside the row, so no
    calendar is joined. ``first_seen`` (key, first_hour) is for rollups that no longer
    reach back to the first sighting.
    """
    by_hour = Window.partitionBy(key).orderBy("_h")
    numbered = dealt(rollups, key).withColumn("_h", hour_number(F.col("bucket_start")))
    if first_seen is None:
        numbered = numbered.withColumn("_h0", F.min("_h").over(Window.partitionBy(key).orderBy("_h")))
    else:
        numbered = (numbered.join(first_seen, key)
                    .withColumn("_h0", hour_number(F.col("first_hour"))).drop("first_hour"))
    look_back = by_hour.rangeBetween(-params.history_hours, -1)
    known = F.map_from_entries(F.collect_list(F.struct("_h", "event_count")).over(look_back))
    start = F.greatest(F.col("_h0"), F.col("_h") - params.history_hours)
    hours = F.when(start < F.col("_h"), F.sequence(start, F.col("_h") - 1)).otherwise(
        F.array().cast("array<bigint>"))
    return (numbered.withColumn("_known", known)
            .withColumn("history", F.transform(
                hours, lambda h: F.coalesce(F.try_element_at("_known", h),
                                            F.lit(0).cast("bigint"))))
            .drop("_known", "_h", "_h0"))


def series_stats(histories: DataFrame) -> DataFrame:
    h = F.col("history")
    return (histories.withColumns({"history_hours": F.size(h), "mean": sr.mean(h),
                                   "zero_share": sr.zero_share(h), "stddev": sr.stddev(h)}))


# -- E3 to E7 -------------------------------------------------------------------------------------
def observe(rollups: DataFrame, params: Params = DEFAULTS, key: str = "group_id",
            first_seen: DataFrame | None = None) -> DataFrame:
    """Every detector's verdict on every bucket that reaches the floor, long format.

    The history is frozen during its hour, so the last verdict of the hour is the verdict
    at the hour's final count: nothing is upserted. The floor is applied after the
    histories are made, since they need the quiet hours too.
    """
    busy = with_history(rollups, params, key, first_seen).filter(
        F.col("event_count") >= params.min_observed)
    judged = sr.with_statistics(busy, "event_count", params)
    verdicts = F.array(*[rule(F.col("event_count"), params) for rule in sr.JUDGES.values()])
    return (judged.select(key, "bucket_start", F.explode(verdicts).alias("_v"))
            .select(key, "bucket_start", "_v.*"))


# -- E11, E12 --------------------------------------------------------------------------------------
def hindsight(rollups: DataFrame, params: Params = DEFAULTS, key: str = "group_id",
              first_seen: DataFrame | None = None) -> DataFrame:
    """Per bucket, the mean of the hours around it and whether it was a real surge.

    The neighbours are summed by one range window; the number of hours, empty ones
    included, is arithmetic on the bounds.
    """
    n = rollups.withColumn("_h", hour_number(F.col("bucket_start")))
    if first_seen is None:
        n = n.withColumn("_h0", F.min("_h").over(Window.partitionBy(key).orderBy("_h")))
    else:
        n = (n.join(first_seen, key)
             .withColumn("_h0", hour_number(F.col("first_hour"))).drop("first_hour"))
    around = Window.partitionBy(key).orderBy("_h").rangeBetween(
        -params.oracle_lookback_hours, params.score_after_hours)
    hours = (F.col("_h") + params.score_after_hours
             - F.greatest(F.col("_h0"), F.col("_h") - params.oracle_lookback_hours))
    baseline = ((F.sum("event_count").over(around) - F.col("event_count")).cast("double")
                / F.greatest(hours, F.lit(1)))
    surge = ((F.col("event_count") >= params.min_observed)
             & (F.col("event_count") >= F.greatest(
                 F.lit(float(params.min_observed)),
                 F.col("oracle_baseline") * params.oracle_multiplier)))
    return (n.withColumn("oracle_baseline", baseline).withColumn("surge", surge)
            .select(key, "bucket_start", "oracle_baseline", "surge"))


def outcome_box(fired: Column, surge: Column) -> Column:
    return (F.when(fired & surge, "true_positive").when(fired, "false_positive")
            .when(surge, "false_negative").otherwise("true_negative"))


def score(observations: DataFrame, oracle: DataFrame, as_of: Column, params: Params = DEFAULTS,
          key: str = "group_id", batch: int | None = None) -> DataFrame:
    """Box each unscored verdict old enough to have hindsight; later ones stay null.

    ``batch`` limits one pass to the oldest verdicts; by default all are scored.
    """
    due = F.date_trunc("hour", as_of) - F.make_interval(hours=F.lit(params.score_after_hours))
    eligible = F.col("bucket_start") <= due
    if "outcome" in observations.columns:
        eligible = eligible & F.col("outcome").isNull()
    else:
        observations = observations.withColumns({
            "outcome": F.lit(None).cast("string"),
            "oracle_baseline": F.lit(None).cast("double")})
    found = oracle.withColumnRenamed("oracle_baseline", "_baseline")
    joined = observations.join(found, [key, "bucket_start"], "left").withColumn("_due", eligible)
    if batch is not None:
        order = [F.col("bucket_start"), F.col(key), F.col("detector")]
        chosen = (joined.filter("_due").orderBy(*order).limit(batch)
                  .select(key, "bucket_start", "detector", F.lit(True).alias("_chosen")))
        joined = (joined.join(chosen, [key, "bucket_start", "detector"], "left")
                  .withColumn("_due", F.coalesce("_chosen", F.lit(False))).drop("_chosen"))
    return (joined
            .withColumn("outcome", F.when(F.col("_due"),
                                          outcome_box(F.col("fired"), F.col("surge")))
                        .otherwise(F.col("outcome")))
            .withColumn("oracle_baseline", F.when(F.col("_due"), F.col("_baseline"))
                        .otherwise(F.col("oracle_baseline")))
            .drop("_due", "_baseline", "surge"))


# -- E13, E14 -------------------------------------------------------------------------------------------
def scorecard(observations: DataFrame, order_by: str = "bucket_start") -> DataFrame:
    """Counts per detector; ``is_active`` is that of its latest observation."""
    boxes = [F.count_if(F.col("outcome") == name).alias(short) for short, name in OUTCOMES.items()]
    return observations.groupBy("detector").agg(
        F.max_by("is_active", order_by).alias("is_active"),
        F.count_if("fired").alias("fired"),
        F.count_if(F.col("outcome").isNotNull()).alias("judged"),
        F.count_if(F.col("outcome").isNull()).alias("pending"),
        *boxes)


def precision_recall(card: DataFrame) -> DataFrame:
    """Ratios, null where nothing was called or nothing was there."""
    return card.withColumns({
        "precision": F.try_divide("tp", F.col("tp") + F.col("fp")),
        "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


# -- E15 to E17 --------------------------------------------------------------------------------------------
def backtest(series: DataFrame, horizon: Column, params: Params = DEFAULTS,
             key: str = "series_id") -> DataFrame:
    """Verdicts and boxes over any (key, bucket_start, event_count) series.

    ``horizon`` is the first hour with no data yet: buckets within ``score_after_hours`` of
    it are left out. Buckets below the floor are skipped; a short history counts as
    "did not fire".
    """
    active = series.filter(F.col("event_count") > 0)
    last = horizon - F.make_interval(hours=F.lit(params.score_after_hours))
    return (observe(active, params, key)
            .filter(F.col("bucket_start") < last)
            .join(hindsight(active, params, key), [key, "bucket_start"])
            .withColumn("outcome", outcome_box(F.col("fired"), F.col("surge"))))


def confusion(boxes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("outcome") == name).alias(short) for short, name in OUTCOMES.items()]
    return boxes.groupBy("detector").agg(*counts)


def disagreements(boxes: DataFrame, key: str = "series_id") -> DataFrame:
    """Buckets that the detectors box differently, one column per detector."""
    columns = [F.max(F.when(F.col("detector") == d, F.col("outcome"))).alias(d) for d in DETECTORS]
    return (boxes.groupBy(key, "bucket_start", "observed", "surge").agg(*columns)
            .filter(~((F.col("ewma") == F.col("zscore")) & (F.col("zscore") == F.col("poisson")))))


def compare_with_recorded(modelled: DataFrame, recorded: DataFrame) -> DataFrame:
    """Model tally beside recorded outcomes per (detector, outcome), and what is pending."""
    model = modelled.groupBy("detector", "outcome").agg(F.count(F.lit(1)).alias("modelled"))
    seen = (recorded.withColumn("outcome", F.coalesce("outcome", F.lit("pending")))
            .groupBy("detector", "outcome").agg(F.count(F.lit(1)).alias("recorded")))
    return (model.join(seen, ["detector", "outcome"], "full_outer")
            .na.fill(0, ["modelled", "recorded"]))


# -- E10 -----------------------------------------------------------------------------------------------------
def gone_quiet(rollups: DataFrame, states: DataFrame, as_of: Column,
               params: Params = DEFAULTS) -> DataFrame:
    """Open groups that were busy for hours inside the window and silent since."""
    now = F.date_trunc("hour", as_of)
    start = now - F.make_interval(hours=F.lit(params.silence_window_hours))
    quiet = now - F.make_interval(hours=F.lit(params.silence_quiet_hours))
    b = F.col("bucket_start")
    counted = (rollups.filter((b > start) & (b <= now)).groupBy("group_id")
               .agg(F.count_if(b <= quiet).alias("busy_hours"),
                    F.count_if(b > quiet).alias("recent_hours")))
    watched = states.filter(F.col("status").isin("open", "regressed")).select("group_id")
    return (counted.filter((F.col("busy_hours") >= params.silence_min_busy_hours)
                           & (F.col("recent_hours") == 0))
            .join(watched, "group_id", "left_semi"))


def gone_quiet_sweeps(rollups: DataFrame, params: Params = DEFAULTS,
                      every_hours: int = 1) -> DataFrame:
    """The same test at every sweep hour: (group_id, sweep_at, busy_hours).

    A sweep on the hour sees the hours before it. A busy hour adds itself to the fewer than
    ``silence_window_hours`` sweeps it can count for, and the sweeps are then a plain
    group-by: no range join. Status is left to the caller, who knows it at each sweep.
    """
    h = F.col("_h")
    step = every_hours
    first = F.ceil((h + 1) / step) * step
    last = h + params.silence_window_hours - 1
    hours = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))
    seen = (rollups.select("group_id", hour_number(F.col("bucket_start")).alias("_h"))
            .withColumn("_sweep", F.explode(hours)))
    old = F.col("_h") <= F.col("_sweep") - params.silence_quiet_hours
    return (seen.groupBy("group_id", "_sweep")
            .agg(F.count_if(old).alias("busy_hours"), F.count_if(~old).alias("recent_hours"))
            .filter((F.col("busy_hours") >= params.silence_min_busy_hours)
                    & (F.col("recent_hours") == 0))
            .select("group_id", F.timestamp_seconds(F.col("_sweep") * 3600).alias("sweep_at"),
                    "busy_hours"))
