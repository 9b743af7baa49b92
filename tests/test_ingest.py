import datetime as dt

from conftest import NOW, hours_ago
from helpers import raw, raw_event
from pyspark.sql import functions as F

from faultsift.contracts import Params
from faultsift.operators import ingest, ranks, retention
from faultsift.sources import sinks


def test_first_violation_and_isolation(spark):
    rows = [raw_event("a", NOW), raw_event("b", NOW, service=" ", level="x" * 21),
            raw_event("c", NOW, message=None), raw_event("d", NOW, stacktrace="t" * 20001),
            raw_event("e", NOW, level="é" * 20), raw_event("f", NOW, level="😀" * 11)]
    got = {r.event_id: r.error for r in ingest.validate(raw(spark, rows)).collect()}
    assert got == {"a": None, "b": "level size must be between 0 and 20",
                   "c": "message must not be blank",
                   "d": "stacktrace size must be between 0 and 20000", "e": None,
                   "f": "level size must be between 0 and 20"}


def test_legacy_fields(spark):
    rows = [
        raw_event("a", NOW, exception_type=None, payload='{"exceptionType":"L","release":"1"}'),
        raw_event("b", NOW, exception_type=" ", release=" ", payload='{"exceptionType":5,"release":[1]}'),
        raw_event("c", NOW, payload='{"stacktrace":["", "", "x", 3, null, {"a":1}, "y"]}'),
        raw_event("d", NOW, payload='{"stacktrace":"one"}', release="2"),
        raw_event("e", NOW, payload='{"stacktrace":[]}'), raw_event("f", NOW, payload="not json"),
        raw_event("g", NOW, payload='{"stacktrace":{"x":1}}'),
    ]
    got = {r.event_id: r for r in ingest.resolve_legacy(raw(spark, rows)).collect()}
    assert (got["a"].exception_type, got["a"].release) == ("L", "1")
    assert (got["b"].exception_type, got["b"].release) == (None, None)
    assert got["c"].stacktrace == 'x\n3\nnull\n{"a":1}\ny'
    assert got["d"].stacktrace == "one" and got["d"].release == "2"
    assert got["e"].stacktrace is got["f"].stacktrace is got["g"].stacktrace is None


def test_rollup_ignores_duplicates(spark):
    rows = [raw_event(f"e{i}", NOW + dt.timedelta(seconds=i)) for i in range(5)]
    rows += [raw_event("e0", NOW + dt.timedelta(minutes=9)), raw_event("e1", NOW, seq=1)]
    events = ingest.store(raw(spark, rows))
    assert [r.event_count for r in ingest.rollup(events).collect()] == [5]
    again = ingest.store(raw(spark, rows + rows))
    assert events.select("event_id", "seq").exceptAll(again.select("event_id", "seq")).count() == 0
    assert ingest.not_yet_stored(raw(spark, rows), events).count() == 0


def test_cap_keeps_first_of_the_hour(spark):
    rows = [raw_event(f"e{i}", NOW + dt.timedelta(seconds=i), stacktrace=f"t{i}", payload="{}")
            for i in range(6)]
    rows += [raw_event(f"n{i}", hours_ago(-2), stacktrace="t") for i in range(2)]
    events = ingest.store(raw(spark, rows))
    capped = ingest.apply_hourly_cap(events, ingest.rollup(events), 3)
    assert capped.count() == 8 and capped.filter("group_id is null").count() == 0
    kept = sorted(r.event_id for r in capped.filter("stacktrace is not null").collect())
    assert kept == ["e0", "e1", "e2", "n0", "n1"]
    assert capped.filter("sampled").count() == 3
    assert ingest.build_groups(events, 3).first().sampled_count == 3
    assert ingest.reconcile_counts(ingest.build_groups(events), ingest.rollup(events)).count() == 0


def test_cap_cuts_within_an_instant(spark):
    rows = [raw_event(f"e{i:02d}", NOW + dt.timedelta(microseconds=i // 3), payload="{}")
            for i in range(30)]
    events = ingest.store(raw(spark, rows))
    rolled = ingest.rollup(events)
    capped = ingest.apply_hourly_cap(events, rolled, 20).collect()
    assert sorted((r.event_id, r.sampled) for r in capped) == [
        (f"e{i:02d}", i >= 20) for i in range(30)]


def test_ids_with_a_long_common_start_are_narrowed_step_by_step(spark, monkeypatch):
    monkeypatch.setattr(ranks, "LAST_CELL", 5)
    rows = [("g", NOW, f"evt-2024-{i:04d}") for i in range(120)]
    events = spark.createDataFrame(rows, "group_id string, received_at timestamp, event_id string")
    keyed = events.withColumn("hour", ingest.hour_of())
    target = keyed.select("group_id", "hour").distinct().withColumn("n", F.lit(77))
    assert ranks.locate_nth(keyed, target, ["group_id", "hour"]).first().nth_id == "evt-2024-0076"


def test_receipts_and_summary(spark):
    rows = [raw_event("a", NOW), raw_event("a", NOW + dt.timedelta(1)), raw_event("b", NOW, message="")]
    events = ingest.store(raw(spark, rows))
    capped = ingest.apply_hourly_cap(events, ingest.rollup(events), 200)
    out = ingest.receipts(raw(spark, rows), capped)
    s = ingest.receipt_summary(out).first()
    assert (s.accepted, s.stored, s.duplicates, s.failed) == (3, 1, 1, 1)
    assert {r.outcome: r.events for r in ingest.outcome_metrics(out).collect()} == {
        "stored": 1, "duplicate": 1, "rejected": 1}
    bad = out.filter("error is not null").first()
    assert bad.error == "message must not be blank" and not bad.retryable and not bad.stored


def test_group_first_and_last(spark):
    rows = [raw_event("a", hours_ago(3), level="info", release=None, message="m 1"),
            raw_event("b", hours_ago(2), level="warning", release="1.0", message="m 2"),
            raw_event("c", hours_ago(1), level="error", release="1.1", message="m 3"),
            raw_event("d", hours_ago(0), level="fatal", release=None, message="m 4")]
    events = ingest.store(raw(spark, rows))
    g = ingest.build_groups(events).collect()
    assert len(g) == 1 and (g[0].level, g[0].event_count) == ("fatal", 4)
    assert (g[0].release_first, g[0].release_last) == ("1.0", "1.1")
    ages = ingest.with_group_age(events, ingest.build_groups(events))
    assert sorted(r.age_hours for r in ages.collect()) == [0, 1, 2, 3]
    span = ingest.release_range(events).first()
    assert (span.release_first, span.release_last) == ("1.0", "1.1")


def test_missing_ids_are_repeatable(spark):
    rows = [raw_event(None, NOW), raw_event(None, NOW, message="other")]
    once, twice = (sorted(r.event_id for r in ingest.assign_event_ids(raw(spark, rows)).collect())
                   for _ in range(2))
    assert once == twice and len(set(once)) == 2


def test_locate_nth_against_ranking(spark):
    """A hot key, ties on the second and on the instant."""
    events = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("group_id"),
        F.timestamp_seconds(1_700_000_000 + (F.col("id") * 37) % 9000).alias("received_at"),
        F.col("id").cast("string").alias("event_id")).withColumn("hour", ingest.hour_of())
    targets = events.groupBy("group_id", "hour").agg(
        (F.count("*") / 2).cast("int").alias("n")).filter("n > 0")
    got = {(r.group_id, r.hour): (r.nth_at, r.nth_id) for r in
           ranks.locate_nth(events, targets, ["group_id", "hour"]).collect()}
    want = {}
    by_key = {}
    for r in events.collect():
        by_key.setdefault((r.group_id, r.hour), []).append((r.received_at, r.event_id))
    for r in targets.collect():
        want[(r.group_id, r.hour)] = sorted(by_key[(r.group_id, r.hour)])[r.n - 1]
    assert got == want


def test_retention(spark):
    rows = [raw_event(f"e{d}", NOW - dt.timedelta(days=d)) for d in (0, 3, 16, 20)]
    events = ingest.store(raw(spark, rows))
    now = F.lit(NOW).cast("timestamp")
    gone = retention.expired(events, now, F.lit(14))
    assert sorted(r.event_id for r in gone.collect()) == ["e16", "e20"]
    assert retention.survivors(events, now, F.lit(14)).count() == 2
    assert retention.survivors(events, now, F.lit(14), limit=1).count() == 3
    sizes = spark.createDataFrame([(0,), (314572800,), (419430400,)], "b bigint")
    assert [r[0] for r in sizes.select(retention.window_days(F.col("b"))).collect()] == [14, 7, 3]
    rolled = ingest.rollup(events)
    assert retention.trend_loss(rolled, rolled).count() == 0
    row = retention.sweep_record(gone, "manual", 14, 7, NOW).first()
    assert (row.deleted_events, row.window_days, row.events_bytes) == (2, 14, 7)
    assert ingest.store(raw(spark, rows), Params(fingerprint_version=2)).first().fingerprint_version == 2


def _group_rows(df):
    return {r.group_id: (r.title, r.level, r.first_seen, r.last_seen, r.event_count, r.release_first,
                         r.release_last, r.sampled_count) for r in df.collect()}


def test_merged_groups_keep_what_is_known_and_survive_retention(spark):
    days = [NOW + dt.timedelta(days=d) for d in range(4)]
    rows = [raw_event(f"e{i}", at + dt.timedelta(minutes=i % 3), level="error" if i % 2 else "warn",
                      release=None if i < 3 else f"r{i}") for i, at in enumerate(days * 3)]
    whole = ingest.build_groups(ingest.store(raw(spark, rows)), 1)
    groups, stored, rolled = None, None, None
    for day in days:
        end = day + dt.timedelta(days=1) - dt.timedelta(hours=12)
        part = raw(spark, rows).filter((F.col("received_at") >= day) & (F.col("received_at") < end))
        batch = ingest.store(part, stored=stored)
        hours = ingest.rollup(batch)
        rolled = hours if rolled is None else ingest.merge_rollups(rolled, hours)
        new = ingest.build_groups(batch, 1)
        groups = new if groups is None else ingest.merge_groups(groups, new, rolled, 1)
        stored = batch  # everything older is gone
    assert _group_rows(groups) == _group_rows(whole)
    again = ingest.store(raw(spark, rows), stored=ingest.store(raw(spark, rows)))
    assert again.count() == 0


def test_a_sweep_takes_its_window_from_the_stored_size(spark):
    rows = [raw_event(f"e{d}", NOW - dt.timedelta(days=d), message="m" * 100) for d in range(20)]
    events = ingest.store(raw(spark, rows))
    for size, days, gone in ((None, 14, 5), (350 * 1024 * 1024, 7, 12), (500 * 1024 * 1024, 3, 16)):
        left, record = retention.sweep(events, NOW, size=size)
        row = record.first()
        assert (row.window_days, row.deleted_events, left.count()) == (days, gone, 20 - gone)
        assert row.events_bytes == (size or retention.stored_bytes(events, retention.TEXT_COLUMNS).first()[0])
    left, record = retention.sweep(events, NOW, limit=2)
    assert record.first().deleted_events == 2 and left.count() == 18


def test_sweep_queries_keep_their_window_under_pressure(spark, monkeypatch):
    from faultsift.plans.registry import QUERIES
    from faultsift.plans.warehouse import Warehouse

    sf = "/root/testdata/sf0.001"
    calm = QUERIES["G4_trend_survives"](spark, sf).first()
    status = QUERIES["H12_storage_status"](spark, sf).first()
    assert status.events_bytes == retention.stored_bytes(
        Warehouse(spark, sf).events(), retention.TEXT_COLUMNS).first()[0]
    monkeypatch.setattr(retention, "stored_bytes", lambda *_: spark.createDataFrame([(10 ** 12,)], "events_bytes bigint"))
    assert QUERIES["G4_trend_survives"](spark, sf).first() == calm and calm.events_left > 0
    full = QUERIES["H12_storage_status"](spark, sf).first()
    assert (full.last_sweep_window_days, full.last_sweep_deleted) == (14, status.last_sweep_deleted)
    assert full.events_bytes == 10 ** 12


def test_replacing_merge_touches_only_its_days(spark, tmp_path):
    rows = [("a", "ewma", NOW, 1), ("b", "ewma", NOW - dt.timedelta(days=3), 2)]
    columns = "group_id string, detector string, bucket_start timestamp, v int"
    sinks.write_table(spark.createDataFrame(rows, columns), str(tmp_path), "observations")
    new = spark.createDataFrame([("a", "ewma", NOW, 7), ("c", "ewma", NOW, 8)], columns)
    for _ in range(2):
        sinks.merge_partitions(new, str(tmp_path), "observations", sinks.replacing(*sinks.OBSERVATION_KEYS))
    sinks.merge_partitions(new.limit(0), str(tmp_path), "observations", sinks.replacing(*sinks.OBSERVATION_KEYS))
    got = sorted((r.group_id, r.v) for r in sinks.read_table(spark, str(tmp_path), "observations").collect())
    assert got == [("a", 7), ("b", 2), ("c", 8)]


def test_derived_tables_are_laid_out_once(spark, tmp_path):
    from faultsift.plans import registry
    from faultsift.plans.warehouse import Warehouse

    w = Warehouse(spark, "/root/testdata/sf0.001")
    # What is shuffled by day is the raw record, not its frames and keys.
    laid_out = ingest.store(w.raw(), w.params, by_day=True)
    plan = laid_out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("fingerprint_input") < plan.index("RebalancePartitions")
    plain = ingest.store(w.raw(), w.params)
    assert laid_out.columns == plain.columns
    assert laid_out.exceptAll(plain).isEmpty() and plain.exceptAll(laid_out).isEmpty()
    assert not {"frames", "in_app_frames", "fingerprint_input", "title"} & set(w.stored().columns)
    landed = spark.read.format("binaryFile").load(registry._landing(w)).select("path").collect()
    assert landed and all(r.path.endswith(".json.gz") for r in landed)
