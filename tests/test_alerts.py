import datetime as dt
import random

import pytest
from conftest import HOUR, NOW, hours_ago
from helpers import minutes, rollups, simple_events
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, Params
from faultsift.operators import alerts, ingest, lifecycle

CAND = "group_id string, kind string, at timestamp, event_id string"


def greedy(rows, width):
    kept, last = [], {}
    for g, kind, at, eid in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if (g, kind) not in last or at - last[(g, kind)] >= width:
            last[(g, kind)] = at
            kept.append((g, kind, at, eid))
    return sorted(kept)


def test_cooldown_fold(spark):
    rows = [("g", "spike", HOUR + minutes(m), f"e{m}") for m in (0, 30, 60, 100, 130)]
    got = alerts.emit_with_cooldown(spark.createDataFrame(rows, CAND), 60)
    assert sorted(r.event_id for r in got.collect()) == ["e0", "e130", "e60"]


@pytest.mark.parametrize("seed,step", [(1, 40), (2, 11), (3, 3)])
def test_cooldown_against_one_by_one(spark, seed, step):
    """Sparse to dense candidates, one group with most of them, ties on the instant."""
    rng = random.Random(seed)
    rows = []
    for g, n in (("hot", 250), ("b", 60), ("c", 5)):
        at = HOUR
        for i in range(n):
            at += dt.timedelta(seconds=rng.choice([0, 7, 60 * step, rng.randrange(1, 7200)]))
            rows.append((g, rng.choice(["spike", "regression"]), at, f"{g}{i:04d}"))
    got = alerts.emit_with_cooldown(spark.createDataFrame(rows, CAND), 60).collect()
    assert sorted(map(tuple, got)) == greedy(rows, minutes(60))


def test_long_runs_of_touching_slots_take_log_rounds(spark, monkeypatch):
    """A key that never rests for 10,000 hours, one with a third of its rows in one second, and sparse ones."""
    rng = random.Random(7)
    start, rows = dt.datetime(2025, 1, 1), []
    for i in range(15_000):
        rows.append(("hot", "spike", start + dt.timedelta(minutes=40 * i, microseconds=rng.randrange(10 ** 9)), f"h{i:05d}"))
    for i in range(6_000):
        at = start + (dt.timedelta(hours=7, microseconds=rng.randrange(500)) if i % 3 == 0 else
                      dt.timedelta(seconds=rng.randrange(400_000)))
        rows.append(("dense", "spike", at, f"d{i:05d}"))
    rows += [("rare", "spike", start + dt.timedelta(hours=3 * i), f"r{i}") for i in range(50)]
    rounds, cut = [], alerts.cut
    monkeypatch.setattr(alerts, "cut", lambda df: rounds.append(1) or cut(df))
    got = alerts.emit_with_cooldown(spark.createDataFrame(rows, CAND), 60).collect()
    assert sorted(map(tuple, got)) == greedy(rows, minutes(60))
    assert sum(r.group_id == "hot" for r in got) > 7_000 and len(rounds) <= 17


def test_cooldown_of_no_candidates(spark):
    assert alerts.emit_with_cooldown(spark.createDataFrame([], CAND), 60).count() == 0


def test_cooldown_continues_from_earlier_alerts(spark):
    rows = [("g", "spike", HOUR + minutes(m), f"e{m}") for m in (10, 50, 70)]
    sent = spark.createDataFrame([("g", "spike", HOUR - minutes(10))],
                                 "group_id string, kind string, last_at timestamp")
    got = alerts.emit_with_cooldown(spark.createDataFrame(rows, CAND), 60, sent).collect()
    assert [r.event_id for r in got] == ["e50"]


def test_hour_grid_agrees_with_the_general_form(spark):
    rng = random.Random(5)
    rows = [(g, "silence", hours_ago(h), "") for g in "abc" for h in range(120) if rng.random() < .4]
    df = spark.createDataFrame(rows, CAND)
    assert sorted(map(tuple, alerts.emit_on_hour_grid(df, 1440).collect())) == greedy(
        rows, minutes(1440))


def test_silence_sweeps_raise_one_alert(spark):
    r = rollups(spark, [("g", hours_ago(h), 5) for h in range(30, 40)])
    none = spark.createDataFrame([], "group_id string, status string, since timestamp, until timestamp")
    cands = alerts.silence_candidates(r, none, every_hours=3)
    assert cands.count() > 3
    assert alerts.emit_on_hour_grid(cands, 1440).count() == 1
    ignored = spark.createDataFrame([("g", "ignored", hours_ago(35), None)],
                                    "group_id string, status string, since timestamp, until timestamp")
    assert alerts.silence_candidates(r, ignored).count() == 0


def _history(hours=24, n=5):
    rows = []
    for h in range(1, hours + 1):
        rows += [("g", hours_ago(h) + minutes(i), f"h{h:02d}-{i}") for i in range(n)]
    return rows


def test_spike_is_raised_at_the_event_that_crosses(spark):
    rows = _history() + [("g", HOUR + minutes(i), f"now-{i:02d}") for i in range(40)]
    events = simple_events(spark, rows)
    rolled = ingest.rollup(events)
    points = alerts.firing_points(rolled)
    assert [(r.n, r.hour) for r in points.collect()] == [(16, HOUR)]
    spikes = alerts.emit_with_cooldown(
        alerts.spike_candidates(events, alerts.spike_instants(events, points)), 60)
    assert [r.event_id for r in spikes.collect()] == ["now-15"]
    groups = events.groupBy("group_id").agg(F.lit("boom").alias("title"))
    row = alerts.raise_alerts(spikes, groups, alerts.spike_details(spikes, events, points),
                              delivery=False).first()
    assert (row.detector, row.observed, row.baseline, row.delivery_state) == ("ewma", 16, 5.0, "disabled")
    assert row.score == pytest.approx(3.2) and row.bucket_start == HOUR and row.title == "boom"


def test_new_group_rule(spark):
    def cands(gaps):
        rows = [("g", HOUR + minutes(m), f"e{i:02d}") for i, m in enumerate(gaps)]
        ev = simple_events(spark, rows)
        g = ev.groupBy("group_id").agg(F.min("received_at").alias("first_seen"))
        return [r.event_id for r in alerts.new_group_candidates(ev, g).orderBy("at").collect()]

    assert cands(range(12)) == ["e09", "e10", "e11"]
    assert cands([20 * i for i in range(12)]) == []  # the tenth comes at three hours
    assert cands([0] * 8 + [170, 179, 181]) == ["e09"]


def _world(spark, rows, changes):
    events = simple_events(spark, rows)
    groups = events.groupBy("group_id").agg(F.min("received_at").alias("first_seen"))
    log = spark.createDataFrame(
        changes, "group_id string, changed_at timestamp, status string, release string")
    iv = lifecycle.status_intervals(log, groups, events)
    back = lifecycle.regressions(iv, events)
    return groups, iv, back


def _state(spark, rows, changes, at=None):
    groups, iv, back = _world(spark, rows, changes)
    return lifecycle.group_states(groups, iv, back, F.lit(at or NOW).cast("timestamp")).first()


def test_regression_once_and_in_its_release(spark):
    rows = [("g", hours_ago(9), "a", "1.4.0"), ("g", hours_ago(5), "b", "1.6.0"),
            ("g", hours_ago(3), "c", "1.7.0")]
    changes = [("g", hours_ago(7), "resolved", "1.5.0"), ("x", hours_ago(7), "resolved", None)]
    s = _state(spark, rows, changes)
    assert (s.status, s.regressed_in_release, s.resolved_in_release) == ("regressed", "1.6.0", "1.5.0")
    assert s.regressed_at == hours_ago(5)
    assert _state(spark, rows, changes, hours_ago(6)).status == "resolved"
    assert _state(spark, rows, changes, hours_ago(8)).status == "open"
    _, _, back = _world(spark, rows, changes)
    assert back.count() == 1


def test_ignored_reopened_and_implied_release(spark):
    rows = [("g", hours_ago(9), "a", "1.4.0"), ("g", hours_ago(8), "b"), ("g", hours_ago(5), "c", "1.6.0")]
    assert _state(spark, rows, [("g", hours_ago(7), "ignored", None)]).status == "ignored"
    s = _state(spark, rows, [("g", hours_ago(7), "resolved", None), ("g", hours_ago(2), "open", None)])
    assert (s.status, s.regressed_at, s.resolved_at) == ("open", None, None)
    s = _state(spark, rows[:2], [("g", hours_ago(7), "resolved", None)])
    assert (s.status, s.resolved_in_release) == ("resolved", "1.4.0")


def test_same_hour_order_matters(spark):
    rows = [("g", HOUR + minutes(1), "a", "1"), ("g", HOUR + minutes(9), "b", "2")]
    s = _state(spark, rows, [("g", HOUR + minutes(5), "resolved", None)])
    assert (s.status, s.regressed_at, s.resolved_in_release) == ("regressed", HOUR + minutes(9), "1")


def test_timeline_and_triage(spark):
    rows = [("g", hours_ago(9), "a"), ("g", hours_ago(5), "b")]
    _, iv, back = _world(spark, rows, [("g", hours_ago(7), "resolved", None)])
    pieces = sorted((r.since, r.status, r.until) for r in lifecycle.status_timeline(iv, back).collect())
    assert pieces == [(hours_ago(7), "resolved", hours_ago(5)), (hours_ago(5), "regressed", None)]
    with pytest.raises(ValueError):
        lifecycle.triage_list(None, limit=501)


def test_delivery_fold_queue_and_feed(spark):
    made = spark.createDataFrame(
        [(a, "g", "spike", NOW - minutes(i), "pending", "t") for i, a in enumerate("abcd")],
        "alert_id string, group_id string, kind string, created_at timestamp, "
        "delivery_state string, title string").withColumns({
            "detector": F.lit("ewma"), "observed": F.lit(1), "baseline": F.lit(1.0),
            "score": F.lit(1.0)})
    log = ([("a", NOW, True, None)] + [("b", NOW + minutes(i), False, "x" * 900) for i in range(7)]
           + [("c", NOW, False, None), ("c", NOW + minutes(1), True, None)])
    attempts = spark.createDataFrame(log, "alert_id string, attempted_at timestamp, ok boolean, error string")
    out = alerts.fold_deliveries(made, attempts, DEFAULTS)
    got = {r.alert_id: (r.delivery_state, r.delivery_attempts, len(r.last_error or "")) for r in out.collect()}
    assert got == {"a": ("sent", 1, 0), "b": ("failed", 5, 500), "c": ("sent", 2, 0), "d": ("pending", 0, 0)}
    half = alerts.fold_deliveries(made, attempts.limit(3), Params(max_attempts=5))
    assert {r.alert_id: r.last_error for r in half.collect()}["b"] is not None
    groups = spark.createDataFrame([("g", "svc", "c", 4, "open")],
                                   "group_id string, service string, culprit string, event_count bigint, status string")
    assert [r.alert_id for r in alerts.pending_queue(out, groups).collect()] == ["d"]
    assert [r.alert_id for r in alerts.alert_feed(out, groups, 2).collect()] == ["a", "b"]
