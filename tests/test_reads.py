import datetime as dt
import random
import time

from conftest import HOUR, NOW, hours_ago
from helpers import raw, raw_event, rollups
from pyspark.sql import functions as F

from faultsift.functions.trigram import jaccard, trigrams
from faultsift.operators import ingest, reads, reconcile, similar


def _groups(spark, n=9):
    rows = [(f"g{i}", f"Title {i % 3}", "svc" + str(i % 2), "open" if i % 4 else "resolved",
             HOUR - dt.timedelta(minutes=i // 2), i) for i in range(n)]
    return spark.createDataFrame(rows, "group_id string, title string, service string, status string, "
                                       "last_seen timestamp, event_count bigint").withColumns({
        c: F.lit(None).cast("string") for c in ("platform", "level", "culprit", "degraded_reason")
    }).withColumn("first_seen", F.col("last_seen"))


def test_paging_sees_every_group_once(spark):
    groups, seen, after = _groups(spark), [], None
    for _ in range(3):
        page = reads.group_page(groups, 3, after).collect()
        seen += [r.group_id for r in page[:3]]
        more = len(page) > 3
        after = (page[2].last_seen, page[2].group_id)
    assert len(seen) == len(set(seen)) == 9 and not more
    assert reads.group_page(groups, 9, q="TITLE 1", service="svc1").count() == 2
    assert {r.status: r.n for r in reads.counts_by_status(groups).collect()} == {"open": 6, "resolved": 3}
    assert [r.service for r in reads.list_services(groups).collect()] == ["svc0", "svc1"]


def test_a_filter_with_a_backslash_matches_itself(spark):
    groups = spark.createDataFrame([(r"at C:\work\a.js",), ("at C:/work",), ("100 %",)], "title string")
    titles = lambda q: [r.title for r in reads.matching(groups, q=q).collect()]
    assert titles(r"c:\WORK") == [r"at C:\work\a.js"] and len(titles("c:_work")) == 2


def test_trend_widening_and_series(spark):
    groups = spark.createDataFrame([("g", "s", "open", "t")], "group_id string, service string, status string, title string")
    old = rollups(spark, [("g", hours_ago(24 * 10), 7)])
    daily = reads.overview_trend(old, groups, NOW, "30d", service="s").collect()
    assert len(daily) == 30 and sum(r.event_count for r in daily) == 7
    assert sum(r.event_count for r in reads.overview_trend(old, groups, NOW, "30d", service="x").collect()) == 0
    events, none = old, old.limit(0)
    assert reads.widened_overview(old, groups, events, NOW).count() == 30
    assert reads.widened_overview(old, groups, none, NOW).count() == 7  # retention left no event
    assert reads.widened_overview(old, groups, events, NOW, asked="7d").count() == 7
    new = rollups(spark, [("g", hours_ago(1), 7), ("g", hours_ago(23), 1), ("g", hours_ago(24), 9)])
    assert reads.widened_overview(new, groups, events, NOW).count() == 7
    hourly = reads.group_series(new, "g", NOW, "24h").orderBy("iso").collect()
    assert len(hourly) == 24 and hourly[0].event_count == 1 and hourly[-2].event_count == 7
    assert hourly[-1].label == "12:00"
    assert reads.sparklines(new, NOW).first().daily == [0, 0, 0, 0, 0, 10, 7]
    s = reads.trend_summary(rollups(spark, [("g", hours_ago(3), 4), ("g", hours_ago(2), 4)]), "group_id").first()
    assert (s.total, s.peak, s.first_peak_at) == (8, 4, hours_ago(3))


def test_trigram_value(spark):
    df = spark.createDataFrame([("word", "two words"), ("", ""), ("a", "a")], "a string, b string")
    got = [r[0] for r in df.select(jaccard(trigrams(F.col("a")), trigrams(F.col("b")))).collect()]
    assert round(got[0], 6) == 0.363636 and got[1] == 0.0 and got[2] == 1.0


def _grams(text):
    import re
    out = set()
    for w in re.split(r"[\W_]+", text.lower()):
        if w:
            p = f"  {w} "
            out |= {p[i:i + 3] for i in range(len(p) - 2)}
    return out


def test_all_pairs_against_brute_force(spark):
    """A third of the groups share one title; others form near copies and strays."""
    rng = random.Random(3)
    words = "order cart user payment timeout refused missing null index cache".split()
    titles = ["Timeout: payment refused"] * 40
    titles += [" ".join(rng.sample(words, 3)) for _ in range(60)] + ["", "zq", "Zq"]
    rows = [(f"g{i:03d}", t) for i, t in enumerate(titles)]
    got = {}
    for r in similar.similar_groups(spark.createDataFrame(rows, "group_id string, title string")).collect():
        got.setdefault(r.group_id, []).append((r["rank"], r.similar_id, r.score))
    grams = {g: _grams(t) for g, t in rows}
    for g, _ in rows:
        best = []
        for o, _ in rows:
            union = len(grams[g] | grams[o])
            s = len(grams[g] & grams[o]) / union if union else 0
            if o != g and s > 0.3:
                best.append((-s, o))
        want = [(i + 1, o) for i, (_, o) in enumerate(sorted(best)[:5])]
        assert [(a, b) for a, b, _ in sorted(got.get(g, []))] == want, g


def test_many_titles_with_shared_words(spark):
    """20,000 titles of a small vocabulary: few pairs meet, long lists are dealt over blocks, results are exact."""
    rng = random.Random(8)
    common = "error in order service cannot load item of user".split()
    rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9))) for _ in range(3000)]
    rows = [(f"g{i:05d}", " ".join(rng.sample(common, 3) + rng.sample(rare, 3))) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "group_id string, title string")
    started = time.time()
    got = {}
    for r in similar.similar_groups(frame).collect():
        got.setdefault(r.group_id, []).append((r["rank"], r.similar_id))
    assert time.time() - started < 120
    grams = [(g, _grams(t)) for g, t in rows]
    for g, mine in rng.sample(grams, 25):
        scored = ((-len(mine & o) / len(mine | o), i) for i, o in grams if i != g)
        best = sorted(x for x in scored if -x[0] > 0.3)[:5]
        assert sorted(got.get(g, [])) == [(n + 1, i) for n, (_, i) in enumerate(best)], g
    nodes = similar.rare_first(frame.select(F.col("group_id").alias("node"), F.lit(1).alias("carriers"),
                                            similar.codes(similar.trigrams(F.col("title"))).alias("_set")))
    for level, most in ((0.6, 6_000_000), (0.45, 20_000_000)):  # of 400 million
        assert similar.meetings(nodes, nodes, level).count() < most


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(f"g{i:03d}", " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(3)) for _ in range(3)))
            for i in range(150)]
    frame = spark.createDataFrame(rows, "group_id string, title string")
    want = sorted(map(tuple, similar.similar_groups(frame).collect()))
    monkeypatch.setattr(similar, "BLOCK", 7)
    assert sorted(map(tuple, similar.similar_groups(frame).collect())) == want


def test_similar_to_one(spark):
    df = spark.createDataFrame([(1, "small ring"), (2, "small rings"), (3, "big thing")], "id int, title string")
    got = similar.similar_to(df, "small ring", "id", exclude=F.col("id") == 1).collect()
    assert [r.id for r in got] == [2]


def test_reconciliation(spark):
    plan = spark.createDataFrame(
        [("a", 0, hours_ago(1), 5), ("b", 1, hours_ago(1), 5), ("a", 0, hours_ago(2), 4),
         ("a", 0, hours_ago(3), 3), ("b", 1, hours_ago(3), 3)],
        "service string, service_order int, hour timestamp, planned bigint")
    sent = spark.createDataFrame(
        [("a", hours_ago(1), 2), ("b", hours_ago(1), 6), ("a", hours_ago(2), 4), ("a", hours_ago(3), 9),
         ("z", hours_ago(3), 9)], "service string, hour timestamp, delivered bigint")
    owed = {(r.service, r.hour): r.owed for r in reconcile.remainder(plan, sent).collect()}
    assert owed == {("a", hours_ago(1)): 3, ("b", hours_ago(3)): 3}
    got = {r.hour: (r.state, r.notes) for r in reconcile.drift(plan, sent).collect()}
    assert got == {hours_ago(1): ("over", "a 2/5, b 6/5"), hours_ago(2): ("intact", ""),
                   hours_ago(3): ("short", "a 9/3, b 0/3")}


def test_delivered_counts_need_no_fingerprint(spark, monkeypatch):
    rows = [raw_event(f"e{i}", hours_ago(i % 3), service=f"s{i % 2}", stacktrace=f"t{i}") for i in range(20)]
    rows += [raw_event("e0", hours_ago(5), seq=1), raw_event("bad", NOW, service=" "), raw_event(None, NOW), raw_event(None, NOW)]
    feed = raw(spark, rows)
    events = ingest.store(feed)
    by_groups = reconcile.delivered(ingest.rollup(events), ingest.build_groups(events))
    want = sorted(map(tuple, by_groups.collect()))
    monkeypatch.setattr(ingest, "with_fingerprint", None)
    got = reconcile.delivered_by_service(ingest.accepted(feed))
    assert sorted(map(tuple, got.select(*by_groups.columns).collect())) == want and sum(r[2] for r in want) == 21


def test_storage_and_nav(spark):
    events = spark.createDataFrame([(NOW,), (hours_ago(5),)], "received_at timestamp")
    empty = spark.createDataFrame([], "ran_at timestamp, source string, window_days int, deleted_events bigint")
    row = reads.storage_status(events, rollups(spark, [("g", HOUR, 1)]), empty).first()
    assert (row.event_rows, row.rollup_rows, row.last_sweep_at) == (2, 1, None)
    assert row.newest_event == "2026-08-10 12:30:00"
    states = spark.createDataFrame([("open",), ("regressed",), ("ignored",)], "status string")
    assert tuple(reads.nav_counts(states, events).first()) == (2, 2)
