import dataclasses
import datetime as dt
import math

import pytest
from conftest import HOUR, NOW, hours_ago
from helpers import rollups
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS
from faultsift.functions import series as sr
from faultsift.operators import detect


def _judge(spark, history, observed, p=DEFAULTS):
    df = spark.createDataFrame([(history, observed)], "history array<bigint>, n bigint")
    df = sr.with_statistics(df, "n", p)
    rules = [rule(F.col("n"), p).alias(name) for name, rule in sr.JUDGES.items()]
    row = df.select(*rules, sr.first_firing_counts(F.col("n"), p).alias("first")).first()
    return row


@pytest.mark.parametrize("history,observed,ewma,zscore,poisson", [
    ([0] * 24, 4, False, False, False),
    ([0] * 3, 50, False, False, False),
    ([0, 0, 18, 0, 1, 12, 0, 0, 15, 2, 0, 0], 20, None, False, True),
    ([0, 0, 0, 30, 0, 0, 28, 0, 0, 0, 31, 0], 29, None, False, True),
    ([5] * 24, 40, True, True, True),
    ([20] * 24, 22, False, False, False),
    ([1] * 24, 12, None, None, True),
    ([50] * 24, 60, None, None, False),
    ([5] * 24, 15, False, None, None),  # exactly three times the baseline does not fire
])
def test_verdicts(spark, history, observed, ewma, zscore, poisson):
    row = _judge(spark, history, observed)
    for name, expected in (("ewma", ewma), ("zscore", zscore), ("poisson", poisson)):
        if expected is not None:
            assert row[name].fired is expected, name


@pytest.mark.parametrize("history,observed", [
    ([2, 5, 2, 5, 0, 4], 9), ([0, 0, 5, 1, 0, 0], 7), ([2, 4, 43, 10, 6, 1], 59), ([6, 4, 0, 3, 2, 3], 9)])
def test_zscore_on_the_threshold_is_that_of_the_statement(spark, history, observed):
    """Counts exactly three deviations above the mean: only the rounding of the deviation decides."""
    import duckdb

    fired, sd = duckdb.sql(f"SELECT ({observed} - list_avg(h)) / greatest(list_stddev_samp(h), 1.0) > 3, "
                           f"list_stddev_samp(h) FROM (SELECT {history} AS h)").fetchall()[0]
    assert _judge(spark, history, observed)["zscore"].fired is fired
    df = spark.createDataFrame([(history,)], "history array<bigint>")
    assert df.select(sr.stddev(F.col("history"))).first()[0] == sd


def test_lower_floor(spark):
    row = _judge(spark, [0] * 24, 4, dataclasses.replace(DEFAULTS, min_observed=1))
    assert row.ewma.fired and row.zscore.fired and row.poisson.fired


@pytest.mark.parametrize("active", ["ewma", "zscore", "poisson"])
def test_first_firing_count_is_the_smallest(spark, active):
    p = dataclasses.replace(DEFAULTS, active_detector=active)
    for history in ([5] * 24, [0] * 10, [1, 2, 3, 4, 5, 6, 7], [10, 11, 10, 10, 11, 40]):
        found = None
        for n in range(5, 60):
            if _fires(history, n, active):
                found = n
                break
        assert _judge(spark, history, 59, p)["first"] == ([found] if found else [])


def _fires(history, n, active):
    mean = sum(history) / len(history)
    if active == "ewma":
        value = float(history[0])
        for x in history[1:]:
            value = 0.3 * x + 0.7 * value
        return n / max(value, 0.5) > 3
    if active == "zscore":
        sd = math.sqrt(sum((x - mean) ** 2 for x in history) / (len(history) - 1))
        return (n - mean) / max(sd, 1.0) > 3
    lam = max(mean, 0.1)
    term = below = math.exp(-lam)
    for k in range(1, n):
        term *= lam / k
        below += term
    return 1 - below < 0.001


def test_poisson_tail_and_stats(spark):
    df = spark.createDataFrame([(1, 1.0), (3, 1.0), (0, 5.0), (500, 0.5), (900, 800.0)],
                               "n int, r double")
    got = [r[0] for r in df.select(sr.poisson_tail(F.col("n"), F.col("r"), 200)).collect()]
    assert got[0] == pytest.approx(0.6321, abs=1e-4) and got[1] == pytest.approx(0.0803, abs=1e-4)
    assert got[2] == 1.0 and 0 <= got[3] <= 1
    assert got[4] == 1.0  # the capped sum cannot see past its terms
    exact = [r[0] for r in df.select(sr.poisson_tail(F.col("n"), F.col("r"), None)).collect()]
    assert exact[1] == pytest.approx(0.0803, abs=1e-4) and exact[4] < 0.001
    assert exact[2] == 1.0 and exact[3] == 0.0


def test_poisson_tail_keeps_its_digits(spark):
    """Against exact rational sums, from common counts to a tenfold surge."""
    cases = [(1, 0.1), (5, 0.1), (20, 4.5), (21, 4.5), (30, 4.5), (60, 45.0), (300, 300.0), (250, 300.0),
             (400, 300.0), (600, 300.0), (3000, 2500.0), (40, 2.0)]
    df = spark.createDataFrame(cases, "n int, r double")
    got = [r[0] for r in df.select(sr.poisson_tail(F.col("n"), F.col("r"))).collect()]
    for (n, rate), tail in zip(cases, got, strict=True):
        term = math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        want, k = 0.0, n
        while term > 1e-320 and k < n + 4000:
            want, k = want + term, k + 1
            term *= rate / k
        assert tail == pytest.approx(want, rel=1e-9), (n, rate)


def test_a_tenfold_surge_of_a_busy_group_fires(spark):
    p = dataclasses.replace(DEFAULTS, active_detector="poisson")
    r = rollups(spark, [("g", hours_ago(h), 300) for h in range(1, 25)] + [("g", hours_ago(0), 3000)])
    fired = {(v.detector, v.fired) for v in detect.observe(r, p).collect() if v.observed == 3000}
    assert ("poisson", True) in fired
    old = dataclasses.replace(p, poisson_max_terms=200)
    assert ("poisson", False) in {(v.detector, v.fired) for v in detect.observe(r, old).collect()
                                  if v.observed == 3000}
    busy = detect.with_history(r, p).filter("event_count = 3000")
    n = sr.with_statistics(busy, "event_count", p).select(
        F.explode(sr.first_firing_counts(F.col("event_count"), p))).first()[0]
    tails = spark.createDataFrame([(n, 300.0), (n - 1, 300.0)], "n long, r double").select(
        sr.poisson_tail(F.col("n"), F.col("r"))).collect()
    assert tails[0][0] < 0.001 <= tails[1][0]


def test_a_history_of_one_or_no_hour(spark):
    h = spark.createDataFrame([([0, 0, 0, 0, 1],), ([],), ([3],)], "history array<bigint>")
    rows = detect.series_stats(h).collect()
    assert (rows[0]["zero_share"], rows[0]["mean"]) == (0.8, 0.2)
    assert (rows[1]["zero_share"], rows[1]["mean"], rows[1]["stddev"]) == (1.0, 0.0, 0.0)
    assert rows[2]["stddev"] == 0.0


def test_history_is_dense_and_starts_at_first_sighting(spark):
    r = rollups(spark, [("g", hours_ago(30), 3), ("g", hours_ago(4), 2), ("g", hours_ago(1), 9),
                        ("h", hours_ago(2), 1), ("h", hours_ago(0), 5)])
    got = {(x.group_id, x.bucket_start): x.history for x in detect.with_history(r).collect()}
    assert got[("g", hours_ago(30))] == []
    assert got[("g", hours_ago(1))] == [0] * 21 + [2, 0, 0]
    assert got[("h", hours_ago(0))] == [1, 0]


CASES = [
    ({1: 40}, (1, True, 40), None),
    ({**{h: 1 for h in range(12, 31)}, 10: 40, 9: 1, 8: 1}, (10, True, 40), "true_positive"),
    ({h: 20 for h in range(8, 31)}, (10, True, 22), "false_positive"),
    ({**{h: 1 for h in range(12, 31)}, 10: 60, 9: 1}, (10, False, 60), "false_negative"),
    ({h: 20 for h in range(8, 31)}, (10, False, 21), "true_negative"),
    ({**{h: 2 for h in range(12, 31)}, 10: 50, **{h: 2 for h in range(5, 10)}}, (10, True, 50),
     "true_positive"),
]


@pytest.mark.parametrize("counts,verdict,outcome", CASES)
def test_scoring(spark, counts, verdict, outcome):
    ago, fired, observed = verdict
    r = rollups(spark, [("g", hours_ago(h), n) for h, n in counts.items()])
    born = spark.createDataFrame([("g", hours_ago(72))], "group_id string, first_hour timestamp")
    seen = spark.createDataFrame([("g", hours_ago(ago), "ewma", fired, observed)],
                                 "group_id string, bucket_start timestamp, detector string, "
                                 "fired boolean, observed bigint")
    oracle = detect.hindsight(r, first_seen=born)
    now = F.lit(NOW).cast("timestamp")
    row = detect.score(seen, oracle, now).first()
    assert row.outcome == outcome
    if observed == 50:
        assert 0.5 <= row.oracle_baseline <= 4
    again = detect.score(detect.score(seen, oracle, now), oracle, now)
    assert again.first().outcome == outcome


def test_scoring_in_batches(spark):
    r = rollups(spark, [("g", hours_ago(h), 20) for h in range(8, 31)])
    seen = detect.observe(r)
    now = F.lit(NOW).cast("timestamp")
    one = detect.score(seen, detect.hindsight(r), now, batch=10)
    assert one.filter("outcome is not null").count() == 10
    assert one.filter("outcome is not null").agg(F.max("bucket_start")).first()[0] <= one.filter(
        "outcome is null").agg(F.min("bucket_start")).first()[0]


@pytest.mark.parametrize("hours,status,expected", [
    (range(4, 12), "open", True), ((9, 10), "open", False),
    ((0, 1, 2, 4, 5, 6, 7, 8), "open", False), ((), "open", False),
    (range(4, 12), "resolved", False), (range(4, 12), "ignored", False),
    (range(4, 12), "regressed", True), (range(30, 38), "open", False),
])
def test_silence(spark, hours, status, expected):
    r = rollups(spark, [("g", hours_ago(h), 5) for h in hours])
    states = spark.createDataFrame([("g", status)], "group_id string, status string")
    got = detect.gone_quiet(r, states, F.lit(NOW).cast("timestamp"))
    assert (got.count() == 1) is expected


def test_sweeps_equal_repeated_single_tests(spark):
    import random
    rng = random.Random(7)
    rows = [(f"g{g}", hours_ago(h), 1) for g in range(6) for h in range(60)
            if rng.random() < (0.15 * g if h % 20 < 12 else 0.02)]
    r = rollups(spark, rows)
    got = {(x.group_id, x.sweep_at) for x in detect.gone_quiet_sweeps(r).collect()}
    states = r.select("group_id").distinct().withColumn("status", F.lit("open"))
    want = set()
    for h in range(-25, 61, 5):
        at = hours_ago(h)
        before = r.filter(F.col("bucket_start") < F.lit(at).cast("timestamp"))
        quiet = detect.gone_quiet(before, states, F.lit(at).cast("timestamp"))
        want |= {(x.group_id, at) for x in quiet.collect()}
    assert {x for x in got if (HOUR - x[1]).total_seconds() / 3600 % 5 == 0
            and x[1] <= hours_ago(-25)} == want


SERIES = {
    "checkout-api": [9, 10, 11, 10, 9, 10, 11, 10, 9, 16, 10, 9, 11, 10, 10, 9, 10, 16, 11, 10, 9, 10,
                     11, 10, 9, 16, 10, 11, 9, 10],
    "search-indexer": [0] * 30,
    "media-transcoder": [10, 11, 10, 10, 11, 40] * 5,
    "notification-worker": [math.floor(4 + 36 * h / 19 + 0.5) if h < 20 else 40 for h in range(30)],
    "payments-api": [40 if h in (14, 26) else [5, 6, 7, 6, 5, 6, 7, 6][h % 8] for h in range(30)],
    "session-store": [30, 28, 32, 30, 29, 31, 30, 28, 30, 32, 29, 30] + [0] * 18,
}
for _h, _n in zip((3, 7, 11, 15, 19, 23, 27), (40, 38, 42, 39, 41, 40, 45)):
    SERIES["search-indexer"][_h] = _n
SERIES["session-store"][24] = 12


def test_backtest_golden(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(name, start + dt.timedelta(hours=h), n) for name, counts in SERIES.items()
            for h, n in enumerate(counts)]
    assert sum(r[2] for r in rows) == 2517
    df = spark.createDataFrame(rows, "series_id string, bucket_start timestamp, event_count bigint")
    boxes = detect.backtest(df, F.lit(start + dt.timedelta(hours=30)).cast("timestamp"))
    got = {r.detector: (r.tp, r.fp, r.fn, r.tn) for r in detect.confusion(boxes).collect()}
    assert got == {"ewma": (6, 4, 2, 114), "zscore": (2, 4, 6, 114), "poisson": (6, 10, 2, 108)}
    assert detect.disagreements(boxes).count() == 17


def test_scorecard_and_ratios(spark):
    rows = ([("ewma", True, "true_positive")] * 9 + [("ewma", True, "false_positive")] * 4
            + [("ewma", False, "false_negative")] * 2 + [("ewma", False, "true_negative")] * 96
            + [("poisson", False, None)])
    df = spark.createDataFrame(rows, "detector string, fired boolean, outcome string").withColumns(
        {"is_active": F.col("detector") == "ewma", "bucket_start": F.lit(HOUR).cast("timestamp")})
    card = {r.detector: r for r in detect.precision_recall(detect.scorecard(df)).collect()}
    e = card["ewma"]
    assert (e.fired, e.judged, e.tp, e.fp, e.fn, e.tn, e.pending) == (13, 111, 9, 4, 2, 96, 0)
    assert round(e.precision, 2) == 0.69 and round(e.recall, 2) == 0.82
    assert card["poisson"].precision is None and card["poisson"].pending == 1
    both = detect.compare_with_recorded(df.filter("outcome is not null"), df)
    assert both.filter("outcome = 'pending'").first().recorded == 1
    assert both.filter("modelled <> recorded").count() == 1


def test_histories_are_dealt_to_all_tasks(spark):
    """Few bytes and much work: they must not be put into one task."""
    rolled = rollups(spark, [(f"g{g}", hours_ago(h), 1) for g in range(40) for h in range(3)])
    assert detect.with_history(rolled).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
