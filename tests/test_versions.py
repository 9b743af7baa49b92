import datetime as dt
import random

import pytest
from conftest import HOUR
from helpers import rollups
from pyspark.sql import functions as F

from faultsift.operators import ingest
from faultsift.operators.pyramid import Pyramid, floor_to, step, tiles
from faultsift.session import scratch_path
from faultsift.sources import versions
from faultsift.sources.versions import daily

DAY = dt.timedelta(days=1)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_merge_touches_its_days_only_and_readers_keep_their_version(spark):
    table = daily(spark, scratch_path(spark, "versions"), "bucket_start")
    table.merge(rollups(spark, [("g", HOUR, 2), ("g", HOUR - DAY, 5)]), ingest.merge_rollups)
    before, old = table.manifest(), table.read()
    table.merge(rollups(spark, [("g", HOUR, 3), ("h", HOUR + DAY, 1)]), ingest.merge_rollups)
    after = table.manifest()
    assert before.parts["2026-08-09"] == after.parts["2026-08-09"] and before.parts["2026-08-10"] != after.parts["2026-08-10"]
    assert _rows(table.read()) == [("g", HOUR - DAY, 5), ("g", HOUR, 5), ("h", HOUR + DAY, 1)]
    assert _rows(old) == [("g", HOUR - DAY, 5), ("g", HOUR, 2)]  # the version it began with
    assert table.read(lambda v, _: v > "2026-08-10").count() == 1
    assert after.parts["2026-08-10"].rows == 1 and after.parts["2026-08-10"].low.startswith("2026-08-10 12:00")


def test_a_repeated_batch_changes_nothing_and_files_stay_few(spark):
    table = daily(spark, scratch_path(spark, "versions"), "bucket_start")
    rng, want = random.Random(2), {}
    for batch in range(12):
        rows = [("g", HOUR - rng.randrange(3) * DAY, rng.randrange(1, 9))]
        for _ in range(2):
            table.merge(rollups(spark, rows), ingest.merge_rollups, "s", batch)
        want[rows[0][1]] = want.get(rows[0][1], 0) + rows[0][2]
        table.vacuum()
    assert _rows(table.read()) == sorted(("g", at, n) for at, n in want.items())
    assert len(spark.read.parquet(f"{table.path}/data").inputFiles()) <= 6 and len(table.versions()) == 2


def test_an_interrupted_change_leaves_the_old_version(spark, monkeypatch):
    table = daily(spark, scratch_path(spark, "versions"), "bucket_start")
    table.merge(rollups(spark, [("g", HOUR, 2)]), ingest.merge_rollups)
    monkeypatch.setattr(table, "_switch", lambda m: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        table.merge(rollups(spark, [("g", HOUR, 3)]), ingest.merge_rollups)
    again = daily(spark, table.path, "bucket_start")
    assert _rows(again.read()) == [("g", HOUR, 2)]
    assert again.vacuum() == 1 and _rows(again.read()) == [("g", HOUR, 2)]


def test_a_second_writer_of_a_version_is_refused(spark):
    table = daily(spark, scratch_path(spark, "versions"), "bucket_start")
    table.merge(rollups(spark, [("g", HOUR, 2)]), ingest.merge_rollups)
    with pytest.raises(RuntimeError):
        table._switch(table.manifest())


def test_clones_share_folders_and_nothing_else(spark):
    table = daily(spark, scratch_path(spark, "versions"), "bucket_start")
    table.merge(rollups(spark, [("g", HOUR, 2), ("g", HOUR - DAY, 5)]), ingest.merge_rollups)
    other = table.clone(scratch_path(spark, "clone"))
    other.replace(other.read(lambda *_: False), touched=[], drop=["2026-08-09"])
    other.merge(rollups(spark, [("g", HOUR, 1)]), ingest.merge_rollups)
    other.vacuum()
    assert _rows(other.read()) == [("g", HOUR, 3)]
    assert _rows(table.read()) == [("g", HOUR - DAY, 5), ("g", HOUR, 2)] and table.stored_bytes() > 0


def test_an_empty_table(spark):
    table = daily(spark, scratch_path(spark, "versions"), "bucket_start")
    with pytest.raises(ValueError):
        table.read()
    table.merge(rollups(spark, []), ingest.merge_rollups)
    assert table.read().count() == 0 and table.read().columns == ["group_id", "bucket_start", "event_count"]
    assert isinstance(table.manifest(), versions.Manifest)


@pytest.mark.parametrize("widest", ["hour", "day", "month"])
def test_tiles_cover_a_window_once_with_the_widest_levels(widest):
    rng = random.Random(3)
    for _ in range(200):
        since = dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randrange(20_000))
        until = since + dt.timedelta(hours=rng.choice([0, 1, 30, 700, 5000]))
        found = tiles(since, until, widest)
        assert len(found) <= 5
        at = since
        for level, first, last in found:
            assert first == at < last and floor_to(first, level) == first and floor_to(last, level) == last
            at = last
        assert at == until
        if widest == "month" and until - since > 70 * DAY:
            assert any(level == "month" for level, _, _ in found)
    assert step(dt.datetime(2024, 12, 1), "month") == dt.datetime(2025, 1, 1)


def test_pyramid_reads_the_widest_rows_and_adds_up(spark):
    pyramid = Pyramid(spark, scratch_path(spark, "pyramid"))
    rng = random.Random(4)
    start = dt.datetime(2026, 1, 20)
    rows = [("gh"[rng.randrange(2)], start + dt.timedelta(hours=h), rng.randrange(1, 5)) for h in range(0, 24 * 90, 5)]
    for number in range(3):
        pyramid.merge(rollups(spark, rows[number::3]), "feed", number)
    pyramid.merge(rollups(spark, rows[:50]), "feed", 2)  # delivered again
    since, until = dt.datetime(2026, 1, 22, 7), dt.datetime(2026, 4, 3, 2)
    want = sum(n for _, at, n in rows if since <= at < until)
    for widest, most in (("hour", 400), ("day", 170), ("month", 60)):
        got = pyramid.read(since, until, widest)
        assert got.agg(F.sum("event_count")).first()[0] == want and got.count() <= most
    month = pyramid.read(dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1), "month")
    assert all("/month/" in f for f in month.inputFiles()) and month.count() == 2
