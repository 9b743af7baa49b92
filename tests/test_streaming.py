import datetime as dt
import random

import pytest
from conftest import HOUR, hours_ago
from helpers import minutes, raw, raw_event, simple_events
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, Params
from faultsift.functions import series as sr
from faultsift.operators import alerts, detect, ingest, lifecycle
from faultsift.session import scratch_path
from faultsift.sources import sinks, wire
from faultsift.streaming import alerting, jobs


class Feed:
    """A landing folder and a stream over it that resumes after every delivery."""

    def __init__(self, spark, start):
        self.spark, self.start = spark, start
        self.landing, self.out, self.ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))

    def deliver(self, df):
        df.coalesce(2).write.mode("append").parquet(self.landing)
        stream = self.spark.readStream.schema(df.schema).parquet(self.landing)
        self.start(stream, self.out, self.ckpt).awaitTermination()


def test_streamed_ingest_equals_batch(spark):
    rows = [raw_event(f"e{i}", hours_ago(5) + minutes(i), message=f"m {i}", service=f"s{i % 3}")
            for i in range(20)]
    again = [raw_event("e3", hours_ago(5) + minutes(30)), raw_event("bad", HOUR, message=" ")]
    feed = Feed(spark, lambda s, out, ckpt: jobs.write_stream(
        jobs.ingest_stream(s, "1 day").select("event_id", "group_id"), out, ckpt))
    feed.deliver(raw(spark, rows[:12] + rows[:2]))
    feed.deliver(raw(spark, rows[10:] + again))
    want = ingest.store(raw(spark, rows)).select("event_id", "group_id")
    got = spark.read.parquet(feed.out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_reports_outcomes(spark):
    rows = [raw_event("a", HOUR), raw_event("b", HOUR, message=""), raw_event("c", HOUR)]
    landing, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    df = raw(spark, rows)
    df.write.parquet(landing)
    q = jobs.write_stream(jobs.ingest_stream(spark.readStream.schema(df.schema).parquet(landing))
                          .select("event_id"), out, ckpt)
    q.awaitTermination()
    seen = [p["observedMetrics"]["ingest"] for p in q.recentProgress if p["observedMetrics"]]
    assert sum(m["valid"] for m in seen) == 2 and sum(m["rejected"] for m in seen) == 1
    assert sinks.table_bytes(spark, out, "") > 0


def test_rollups_in_both_forms(spark):
    events = simple_events(spark, [("g" if i % 3 else "h", hours_ago(9) + minutes(7 * i), f"e{i}")
                                   for i in range(60)])
    parts = [events.filter(F.col("received_at") < F.lit(hours_ago(6)).cast("timestamp")),
             events.filter(F.col("received_at") >= F.lit(hours_ago(6)).cast("timestamp"))]
    kept = Feed(spark, jobs.maintain_rollups)
    closed = Feed(spark, lambda s, out, ckpt: jobs.write_stream(
        jobs.rollup_stream(s, "1 minute"), out, ckpt))
    for part in parts:
        kept.deliver(part)
        closed.deliver(part)
    want = sorted(map(tuple, ingest.rollup(events).collect()))
    assert sorted(map(tuple, jobs.read_maintained_rollups(spark, kept.out).collect())) == want
    last = events.agg(F.max("received_at")).first()[0] - minutes(1)
    assert sorted(map(tuple, spark.read.parquet(closed.out).collect())) == [
        r for r in want if r[1] + minutes(60) <= last]


def _batch_alerts(spark, events, changes, until, params=DEFAULTS):
    """What the batch operators raise before ``until``."""
    groups = events.groupBy("group_id").agg(F.min("received_at").alias("first_seen"))
    log = changes.withColumn("release", F.lit(None).cast("string"))
    back = lifecycle.regressions(lifecycle.status_intervals(log, groups, events), events)
    points = alerts.firing_points(ingest.rollup(events), params)
    cands = (alerts.spike_candidates(events, alerts.spike_instants(events, points))
             .unionByName(alerts.new_group_candidates(events, groups, params))
             .unionByName(alerts.regression_candidates(back)))
    kept = alerts.emit_with_cooldown(cands, 60).filter(F.col("at") < F.lit(until).cast("timestamp"))
    return sorted((r["group_id"], r["kind"], r["at"], r["event_id"]) for r in kept.collect())


def _alert_feed(spark, params=DEFAULTS):
    return Feed(spark, lambda s, out, ckpt: jobs.write_stream(alerting.alert_stream(s, "10 minutes", params), out, ckpt))


def _told(df):
    return sorted((r["group_id"], r["kind"], r["at"], r["event_id"]) for r in df.collect())


def _alert_rows():
    rows = [("g", hours_ago(h) + minutes(i), f"h{h:02d}-{i}") for h in range(3, 27) for i in range(5)]
    rows += [("g", hours_ago(2) + minutes(i), f"x{i:02d}") for i in range(50)]
    rows += [("g", hours_ago(1) + minutes(i % 60), f"y{i:03d}") for i in range(120)]
    rows += [("new", hours_ago(4) + minutes(3 * i), f"n{i:02d}") for i in range(40)]
    rows += [("new", hours_ago(1) + minutes(20), f"t{i}") for i in range(3)]
    changes = [("g", hours_ago(20) + minutes(2), "resolved"), ("g", hours_ago(10), "ignored"), ("g", hours_ago(9), "resolved"),
               ("g", hours_ago(8) - minutes(57), "resolved"), ("new", hours_ago(3) + minutes(30), "resolved"),
               ("other", hours_ago(9), "resolved")]
    return rows, changes


@pytest.mark.parametrize("order", ["in time", "shuffled within an hour"])
def test_alert_stream_equals_batch(spark, order):
    rows, changes = _alert_rows()
    events = simple_events(spark, rows)
    log = spark.createDataFrame(changes, "group_id string, changed_at timestamp, status string")
    feed = _alert_feed(spark)
    whole = alerting.with_changes(events, log)
    if order != "in time":
        dice = random.Random(4)
        mine = [tuple(r) for r in whole.collect()]
        mine.sort(key=lambda r: (r[1] + dt.timedelta(seconds=dice.randrange(590))))
        parts = [spark.createDataFrame(mine[a:b], whole.schema) for a, b in ((0, 90), (90, 250), (250, None))]
    else:
        cuts = [None, hours_ago(2) + minutes(10), hours_ago(1) + minutes(20), None]
        parts = [whole.filter(((F.col("received_at") >= F.lit(a).cast("timestamp")) if a else F.lit(True))
                              & ((F.col("received_at") < F.lit(b).cast("timestamp")) if b else F.lit(True)))
                 for a, b in zip(cuts[:-1], cuts[1:])]
    for part in parts:
        feed.deliver(part)
    written = spark.read.parquet(feed.out)
    want = _batch_alerts(spark, events, log, HOUR - minutes(11))
    assert {k for _, k, _, _ in want} == {"spike", "new_group", "regression"}
    assert _told(alerting.alerts_of(written)) == want
    assert alerting.late_rows(written).count() == 0


def test_late_rows_are_reported_and_change_nothing(spark):
    rows, changes = _alert_rows()
    log = spark.createDataFrame(changes, "group_id string, changed_at timestamp, status string")
    feed = _alert_feed(spark)
    feed.deliver(alerting.with_changes(simple_events(spark, rows), log))
    before = _told(alerting.alerts_of(spark.read.parquet(feed.out)))
    late = [("g", hours_ago(5), "late1"), ("g", hours_ago(30), "late2"), ("fresh", hours_ago(5), "in time for its group")]
    feed.deliver(alerting.with_changes(simple_events(spark, late), log.limit(0)))
    written = spark.read.parquet(feed.out)
    assert _told(alerting.alerts_of(written)) == before
    assert sorted(r["event_id"] for r in alerting.late_rows(written).collect()) == ["late1", "late2"]


def test_state_and_work_do_not_grow_with_batches(spark):
    feed, sizes = _alert_feed(spark), []

    def start(stream, out, ckpt):
        query = jobs.write_stream(alerting.alert_stream(stream, "10 minutes"), out, ckpt)
        query.awaitTermination()
        sizes.append((query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"],
                      sum(p["numInputRows"] for p in query.recentProgress)))
        return query

    feed.start = start
    for day in range(6):
        rows = [("g", hours_ago(200 - 24 * day - h) + minutes(i), f"{day}-{h}-{i}") for h in range(24) for i in range(3)]
        feed.deliver(alerting.with_changes(simple_events(spark, rows), simple_events(spark, []).select(
            "group_id", F.col("received_at").alias("changed_at"), F.col("event_id").alias("status"))))
    assert {n for _, n in sizes} == {72} and len({n for n, _ in sizes[1:]}) == 1


@pytest.mark.parametrize("detector,terms", [("ewma", None), ("zscore", None), ("poisson", None), ("poisson", 200)])
def test_firing_count_equals_the_batch_rule(spark, detector, terms):
    params = Params(active_detector=detector, poisson_max_terms=terms)
    dice = random.Random(6)
    histories = [[dice.choice([0, 0, 1, 4, 30, 180]) for _ in range(dice.randint(4, 24))] for _ in range(60)]
    df = spark.createDataFrame([(i, h, 100_000) for i, h in enumerate(histories)], "i int, history array<bigint>, n bigint")
    got = (sr.with_statistics(df, "n", params).select("i", sr.first_firing_counts(F.col("n"), params).alias("c")).collect())
    assert {r["i"]: (r["c"][0] if r["c"] else None) for r in got} == {
        i: alerting.firing_count(h, params) for i, h in enumerate(histories)}


def test_silence_stream_equals_sweeps(spark):
    rows = [("g", hours_ago(h), f"g{h}") for h in range(40, 50)]
    rows += [("k", hours_ago(h), f"k{h}") for h in range(5, 50, 2)]
    rows += [("end", hours_ago(0), "z")]
    events = simple_events(spark, rows)
    feed = Feed(spark, lambda s, out, ckpt: jobs.write_stream(
        jobs.silence_stream(s, "1 minute"), out, ckpt))
    middle = F.lit(hours_ago(30)).cast("timestamp")
    feed.deliver(events.filter(F.col("received_at") < middle))
    feed.deliver(events.filter(F.col("received_at") >= middle))
    want = detect.gone_quiet_sweeps(ingest.rollup(events)).filter(
        F.col("sweep_at") <= F.lit(HOUR - minutes(1)).cast("timestamp"))
    got = sorted(map(tuple, spark.read.parquet(feed.out).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 0


def test_json_arrays_and_lines(spark):
    import json
    import tempfile
    rows = [{"eventId": "a", "service": "s", "level": "error", "message": "m",
             "payload": '{"release": "1"}', "receivedAt": "2026-08-10T12:00:00.123456Z"},
            {"service": "s", "level": "error", "message": "m2", "receivedAt": "2026-08-10T12:00:01Z"}]
    folder = tempfile.mkdtemp(prefix="spark-json-")
    with open(f"{folder}/one.json", "w") as f:
        json.dump(rows, f)
    got = wire.read_events(spark, folder, multiline=True).orderBy("received_at").collect()
    assert [r.message for r in got] == ["m", "m2"] and got[0].received_at.microsecond == 123456


def test_partition_merge_touches_only_its_dates(spark):
    root = scratch_path(spark, "merge")
    make = lambda rows: spark.createDataFrame(rows, "group_id string, bucket_start timestamp, event_count bigint")
    day = dt.timedelta(days=1)
    sinks.write_table(make([("g", HOUR, 2), ("g", HOUR - day, 5)]), root, "rollups")
    before = {f for f in spark.read.parquet(f"{root}/rollups").inputFiles() if "2026-08-09" in f}
    sinks.merge_partitions(make([("g", HOUR, 3), ("h", HOUR + day, 1)]), root, "rollups",
                           ingest.merge_rollups)
    got = sinks.read_table(spark, root, "rollups")
    assert sorted(map(tuple, got.collect())) == [("g", HOUR - day, 5), ("g", HOUR, 5), ("h", HOUR + day, 1)]
    assert before <= set(spark.read.parquet(f"{root}/rollups").inputFiles())
    assert sinks.read_table(spark, root, "rollups", since=HOUR, until=HOUR + day).count() == 1
