import datetime as dt
import random

from conftest import HOUR, hours_ago
from helpers import minutes, raw, raw_event, rollups, simple_events
from pyspark.sql import functions as F

from faultsift.contracts import Params
from faultsift.operators import ingest, reads, retention, similar
from faultsift.operators.store import EventStore
from faultsift.session import scratch_path
from faultsift.sources import versions
from faultsift.streaming import jobs, metrics

DAY = dt.timedelta(days=1)


def _feed(n=60, days=12):
    return [raw_event(f"e{i}", HOUR - (i % days) * DAY + minutes(i % 50), message=f"m {i % 7}") for i in range(n)]


def _ids(store):
    return sorted(r["event_id"] for r in store.events.read().select("event_id").collect())


def test_an_id_is_known_ten_days_later_and_few_days_are_read(spark):
    store = EventStore(spark, scratch_path(spark, "store"))
    rows = _feed()
    assert store.ingest(raw(spark, rows)).count() == 60
    late = [raw_event("e10", HOUR + minutes(3)), raw_event("e22", HOUR + minutes(4)), raw_event("fresh", HOUR + minutes(5))]
    assert [r.event_id for r in store.ingest(raw(spark, late)).collect()] == ["fresh"]
    assert store.days_read == ["2026-07-31"]  # the two were stored on one day ten days before
    assert _ids(store) == sorted([f"e{i}" for i in range(60)] + ["fresh"])
    assert store.ingest(raw(spark, [raw_event("other", HOUR)])).count() == 1 and len(store.days_read) <= 1


def test_filters_of_a_broken_off_change_are_not_trusted(spark, monkeypatch):
    store = EventStore(spark, scratch_path(spark, "store"))
    store.ingest(raw(spark, _feed(30)))
    monkeypatch.setattr(store, "refresh", lambda: None)
    store.ingest(raw(spark, [raw_event("new", HOUR + minutes(1))]))  # the day's filter is now of an old folder
    again = EventStore(spark, store.events.path.removesuffix("/events"))
    assert again.ingest(raw(spark, [raw_event("new", HOUR + minutes(9))])).count() == 0
    assert "2026-08-10" in again.days_read
    again.refresh()
    assert again.days_that_may_hold(raw(spark, [raw_event("nowhere", HOUR)])) == []


def test_a_batch_that_comes_again_adds_nothing(spark):
    store = EventStore(spark, scratch_path(spark, "store"))
    for number, part in ((0, _feed(20)), (0, _feed(20)), (1, _feed(25)), (0, _feed(60))):
        store.ingest(raw(spark, part), source="s", batch=number)
    assert _ids(store) == sorted(f"e{i}" for i in range(25))
    assert store.ingest(raw(spark, [])).count() == 0


def test_what_is_derived_is_not_shuffled_and_raw_batches_go(spark, monkeypatch):
    plans = []
    merge = versions.VersionedTable.merge

    def watched(self, new, *args, **more):
        plans.append((new._jdf.queryExecution().executedPlan().toString(), more.get("dealt")))
        return merge(self, new, *args, **more)

    monkeypatch.setattr(versions.VersionedTable, "merge", watched)
    store = EventStore(spark, scratch_path(spark, "store"))
    store.ingest(raw(spark, _feed(40)))
    new = store.ingest(raw(spark, _feed(60)))
    assert sorted(r["event_id"] for r in new.collect()) == sorted(f"e{i}" for i in range(40, 60))
    for plan, dealt in plans:  # one exchange, of raw records, below what reads their frames
        assert dealt and plan.count("Exchange rebalance") + plan.count("REBALANCE") > 0
        assert "fingerprint" not in plan[plan.index("Exchange"):]
    store.forget()
    assert store.events._names(f"{store.path}/batches") == [] and len(_ids(store)) == 60


def test_streamed_store_equals_batch(spark):
    path, landing, ckpt = (scratch_path(spark, n) for n in ("store", "in", "ckpt"))
    parts = [_feed(40), _feed(60)[30:], [raw_event("e1", HOUR + 9 * DAY), raw_event("bad", HOUR, message=" ")]]
    for part in parts:
        df = raw(spark, part)
        df.coalesce(1).write.mode("append").parquet(landing)
        jobs.store_stream(spark.readStream.schema(df.schema).parquet(landing), path, ckpt).awaitTermination()
    want = ingest.store(raw(spark, [r for p in parts for r in p])).select("event_id", "group_id", "received_at")
    got = EventStore(spark, path).events.read().select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_sweep_drops_whole_days_and_writes_one(spark):
    rows = [("g", HOUR - i * DAY + minutes(j), f"e{i:02d}-{j:02d}") for i in range(20) for j in range(10)]
    events = simple_events(spark, rows)
    for limit in (None, 0, 5, 25, 40, 10_000):
        table = versions.daily(spark, scratch_path(spark, "sweep"), "received_at")
        table.replace(events)
        before = table.manifest()
        ran_at = HOUR + minutes(5)
        record = retention.sweep_table(table, ran_at, limit=limit, size=1).first()
        want = retention.survivors(events, F.lit(ran_at).cast("timestamp"), F.lit(14), limit)
        assert sorted(map(tuple, table.read().collect())) == sorted(
            map(tuple, want.select(*events.columns).collect())), limit
        assert record.deleted_events == 200 - want.count() and record.window_days == 14
        written = [k for k, p in table.manifest().parts.items() if before.parts.get(k) != p]
        assert len(written) <= 1
        assert retention.sweep_table(table, ran_at - 40 * DAY, size=1).first().deleted_events == 0


def test_sweeps_shorten_under_pressure(spark):
    table = versions.daily(spark, scratch_path(spark, "sweep"), "received_at")
    table.replace(simple_events(spark, [("g", HOUR - i * DAY, f"e{i}") for i in range(20)]))
    limits = Params(pressure_bytes=10, critical_bytes=20)
    assert retention.sweep_table(table, HOUR, params=limits).first().window_days == limits.critical_days
    assert table.read().count() == limits.critical_days + 1


def test_newest_pages_open_few_days(spark):
    rng, rows = random.Random(5), []
    for i in range(40):
        rows += [(f"g{i}-{j}", HOUR - i * DAY - minutes(rng.randrange(900)), f"e{j}") for j in range(6)]
    opened = []
    for many in (20, 40):
        frame = simple_events(spark, [r for r in rows if int(r[0][1:].split("-")[0]) < many])
        table = versions.daily(spark, scratch_path(spark, "pages"), "received_at")
        table.replace(frame)
        for after in (None, (HOUR - 7 * DAY, "g9")):
            for where in (None, F.col("event_id") == "e3", F.col("event_id") == "nothing"):
                page = reads.newest_page(table, "received_at", "group_id", 5, after, where)
                want = reads.keyset_page(frame if where is None else frame.filter(where), "received_at", "group_id", 5, after)
                assert list(map(tuple, page.collect())) == list(map(tuple, want.collect()))
                opened.append(len(page.inputFiles()))
    plain, filtered = opened[0::3], opened[1::3]
    assert max(plain) <= 3 and max(filtered) <= 12 and plain[0] == plain[2]


def test_similar_from_postings_equals_the_scan(spark):
    rng = random.Random(6)
    words = "order cart user payment timeout refused missing null index cache small ring".split()
    rows = [(i, " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(400)] + [(900, ""), (901, None)]
    frame = spark.createDataFrame(rows, "id int, title string")
    index = similar.TitleIndex(spark, scratch_path(spark, "titles"))
    index.add(frame.filter("id < 200"), "id", "title")
    index.add(frame.filter("id >= 200"), "id", "title")
    for title in ("small ring", "Payment: timeout!", "zzz", ""):
        want = similar.similar_to(frame, title, "id", exclude=F.col("id") == 7)
        got = index.similar(title, exclude=F.col("key") == 7)
        assert list(map(tuple, got.collect())) == [(r["id"], r["score"]) for r in want.collect()], title
    few, every = index.similar("ring").inputFiles(), index.table.read().inputFiles()
    assert 0 < len(few) <= 5 < len(every)


def test_counters_of_streams_and_batches(spark):
    path, landing, out, ckpt = (scratch_path(spark, n) for n in ("counters", "in", "out", "ckpt"))
    listener = metrics.CounterListener(spark, path, {"fed"})
    spark.streams.addListener(listener)
    try:
        for part in ([raw_event("a", HOUR), raw_event("b", HOUR, message="")],
                     [raw_event("a", HOUR), raw_event("c", HOUR), raw_event("d", HOUR)]):
            df = raw(spark, part)
            df.coalesce(1).write.mode("append").parquet(landing)
            stream = jobs.ingest_stream(spark.readStream.schema(df.schema).parquet(landing)).select("event_id")
            jobs.write_stream(stream, out, ckpt, name="fed").awaitTermination()
        metrics.drain(spark)
    finally:
        spark.streams.removeListener(listener)
    counted = metrics.Counted(rollups(spark, [("g", HOUR, 2)]), "loaded", F.count(F.lit(1)).alias("rows"))
    counted.df.write.format("noop").mode("overwrite").save()
    for _ in range(2):  # told twice, counted once
        counted.append(path, "load", "r1", HOUR)
    got = {(r["source"], r["metric"]): r["value"] for r in metrics.totals(spark, path).collect()}
    assert got == {("fed", "valid"): 4, ("fed", "rejected"): 1, ("fed", "stored"): 3, ("load", "rows"): 1}
    assert metrics.totals(spark, scratch_path(spark, "none")).count() == 0


def test_growth_of_sampled_counts(spark):
    old, new = [("g", HOUR, 2), ("h", HOUR, 9)], [("g", HOUR, 4), ("g", hours_ago(1), 5), ("h", HOUR, 1), ("k", HOUR, 1)]
    got = ingest.sampled_growth(rollups(spark, old), rollups(spark, new), 3)
    assert {r["group_id"]: r["sampled_count"] for r in got.collect()} == {"g": 3 + 2, "h": 1, "k": 0}
