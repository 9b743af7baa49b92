"""Statistics over an hourly history array and the three detector rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, Params


def _total(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda a, x: a + x)


def mean(h: Column) -> Column:
    return F.when(F.size(h) > 0, _total(h) / F.size(h)).otherwise(0.0)


def stddev(h: Column) -> Column:
    """Sample deviation; 0 below two values.

    Summed by running means (Welford), as databases do: a count that lies exactly on the threshold is then
    decided by the same rounding.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1.0
        running = a["m"] + (x - a["m"]) / n
        return F.struct(n.alias("n"), running.alias("m"),
                        (a["d"] + (x - running) * (x - a["m"])).alias("d"))

    squares = F.aggregate(h, start, step)["d"]
    return F.when(F.size(h) > 1, F.sqrt(squares / (F.size(h) - 1))).otherwise(0.0)


def zero_share(h: Column) -> Column:
    zeros = F.size(F.filter(h, lambda x: x == 0))
    return F.when(F.size(h) > 0, zeros / F.size(h)).otherwise(1.0)


def ewma(h: Column, alpha: float) -> Column:
    """Exponentially weighted mean, seeded with the oldest value; 0 when empty."""
    tail = F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))
    folded = F.aggregate(tail, h[0].cast("double"),
                         lambda value, x: F.lit(alpha) * x + F.lit(1 - alpha) * value)
    return F.when(F.size(h) > 0, folded).otherwise(0.0)


def _log_factorial(k: Column) -> Column:
    """ln k!: a table up to 20, Stirling's series beyond (relative error below 1e-15)."""
    x = k + 1.0
    series = ((x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
              + (1 / 12 - (1 / 360 - 1 / 1260 / (x * x)) / (x * x)) / x)
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")))).otherwise(series)


def _log_term(k: Column, rate: Column) -> Column:
    return k * F.log(rate) - rate - _log_factorial(k)


def poisson_tail(observed: Column, rate: Column, max_terms: int | None = None) -> Column:
    """P(X >= observed).

    The terms are added from ``observed`` away from the mode (upwards above the rate, downwards
    below it) until they vanish, about 9 sqrt(rate) of them, so a tail of any size has its digits.
    With ``max_terms`` the head is added term by term, at most that many, and taken from 1: a
    compatible form, which sees nothing beyond that count.
    """
    if max_terms is not None:
        return _head_tail(observed, rate, max_terms)
    terms = F.sequence(F.lit(0), (F.ceil(9 * F.sqrt(rate)) + 30).cast("int"))
    above = F.struct(F.exp(_log_term(observed, rate)).alias("t"), F.lit(0.0).alias("c"))
    up = F.aggregate(terms, above, lambda a, j: F.struct(
        (a["t"] * (rate / (observed + j + 1))).alias("t"), (a["c"] + a["t"]).alias("c")))["c"]
    below = F.struct(F.exp(_log_term(observed - 1, rate)).alias("t"), F.lit(0.0).alias("c"))
    down = F.aggregate(terms, below, lambda a, j: F.struct(
        (a["t"] * (F.greatest(observed - 1 - j, F.lit(0)) / rate)).alias("t"),
        (a["c"] + a["t"]).alias("c")))["c"]
    return (F.when(observed <= 0, 1.0).when(observed > rate, up)
            .otherwise(F.greatest(F.lit(0.0), 1.0 - down)))


def _head_tail(observed: Column, rate: Column, max_terms: int) -> Column:
    last = F.least(observed - 1, F.lit(max_terms))
    # sequence() would count down from 1 to 0.
    ks = F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(
        F.array().cast("array<int>"))
    start = F.struct(F.exp(-rate).alias("t"), F.exp(-rate).alias("c"))

    def step(a, k):
        t = a["t"] * (rate / k)
        return F.struct(t.alias("t"), (a["c"] + t).alias("c"))

    below = F.aggregate(ks, start, step)["c"]
    return F.when(observed <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - below))


def with_statistics(df: DataFrame, observed: str, p: Params = DEFAULTS) -> DataFrame:
    """Add what the detector rules read: _mean, _ewma, _sd, _rate and _tail.

    Each fold over the history is a column of its own, so that it runs once per row and
    not once per mention.
    """
    h = F.col("history")
    return (df.withColumns({"_mean": mean(h), "_ewma": ewma(h, p.ewma_alpha)})
            .withColumns({"_sd": stddev(h),
                          "_rate": F.greatest("_mean", F.lit(p.poisson_lambda_floor))})
            .withColumn("_tail", poisson_tail(F.col(observed), F.col("_rate"),
                                              p.poisson_max_terms)))


STATISTICS = ["_mean", "_ewma", "_sd", "_rate", "_tail"]


def _eligible(observed: Column, p: Params) -> Column:
    return (F.size("history") >= p.min_history_hours) & (observed >= p.min_observed)


def _verdict(name: str, fired: Column, observed: Column, baseline: Column, score: Column,
             threshold: Column, p: Params) -> Column:
    return F.struct(
        F.lit(name).alias("detector"), F.lit(name == p.active_detector).alias("is_active"),
        (_eligible(observed, p) & fired).alias("fired"),
        observed.cast("bigint").alias("observed"), baseline.alias("baseline"),
        score.alias("score"), threshold.cast("double").alias("threshold"))


def judge_ewma(observed: Column, p: Params = DEFAULTS) -> Column:
    score = observed / F.greatest("_ewma", F.lit(p.ewma_floor))
    return _verdict("ewma", score > p.ewma_multiplier, observed, F.col("_ewma"), score,
                    F.lit(p.ewma_multiplier), p)


def judge_zscore(observed: Column, p: Params = DEFAULTS) -> Column:
    score = (observed - F.col("_mean")) / F.greatest("_sd", F.lit(p.z_sigma_floor))
    return _verdict("zscore", score > p.z_threshold, observed, F.col("_mean"), score,
                    F.lit(p.z_threshold), p)


def judge_poisson(observed: Column, p: Params = DEFAULTS) -> Column:
    tail = F.col("_tail")
    return _verdict("poisson", tail < p.poisson_probability, observed, F.col("_rate"),
                    -F.log10(F.greatest(tail, F.lit(1e-300))),
                    -F.log10(F.lit(p.poisson_probability)), p)


# Name -> rule; a new detector is one more entry.
JUDGES = {"ewma": judge_ewma, "zscore": judge_zscore, "poisson": judge_poisson}


def first_firing_counts(observed: Column, p: Params = DEFAULTS) -> Column:
    """The smallest count of the hour at which the active detector fires, as an array of at
    most one; empty where it does not fire by ``observed``.

    All three scores grow with the count, so for two of them the crossing is arithmetic
    (checked one either side against rounding).
    """
    floor = F.lit(p.min_observed).cast("bigint")

    def near(estimate: Column) -> Column:
        return F.array(*[F.greatest(F.floor(estimate) + i, floor) for i in (-1, 0, 1, 2)])

    if p.active_detector == "ewma":
        level = F.greatest("_ewma", F.lit(p.ewma_floor))
        counts = near(level * p.ewma_multiplier)

        def fires(c):
            return c / level > p.ewma_multiplier
    elif p.active_detector == "zscore":
        spread = F.greatest("_sd", F.lit(p.z_sigma_floor))
        counts = near(F.col("_mean") + spread * p.z_threshold)

        def fires(c):
            return (c - F.col("_mean")) / spread > p.z_threshold
    elif p.active_detector == "poisson":
        if p.poisson_max_terms is None:
            # Chernoff's bound puts the crossing at most this far above the rate.
            need = -math.log(p.poisson_probability)
            over = need / 3 + F.sqrt(need * need / 9 + 2 * need * F.col("_rate"))
            low = F.greatest(F.floor("_rate"), floor)
            top = F.least(observed, F.ceil(F.col("_rate") + over) + 1)
        else:  # past the last term the tail no longer moves
            low, top = floor, F.least(observed, F.lit(p.poisson_max_terms + 1).cast("bigint"))
        counts = F.sequence(low, F.greatest(top, low))

        def fires(c):
            return poisson_tail(c, F.col("_rate"), p.poisson_max_terms) < p.poisson_probability
    else:
        raise ValueError(f"unknown detector {p.active_detector}; known: {sorted(JUDGES)}")
    firing = F.slice(F.filter(counts, fires), 1, 1)
    return F.when(F.size("history") >= p.min_history_hours,
                  F.filter(firing, lambda n: n <= observed))
