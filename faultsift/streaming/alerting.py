"""Spike, new-group and regression alerts from a stream: one keyed state per group."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultsift.contracts import DEFAULTS, Params
from faultsift.operators.ingest import HOUR_US
from faultsift.streaming.jobs import use_rocksdb

ALERT_SCHEMA = T.StructType([
    T.StructField("group_id", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("at", T.TimestampType()), T.StructField("event_id", T.StringType())])
LATE = "late"


# -- the active detector on one history: the smallest count that fires ------------------------------
def _poisson_tail(n: int, rate: float, max_terms: int | None) -> float:
    """P(X >= n); with ``max_terms`` the head is added, at most that many terms, and taken from 1."""
    if n <= 0:
        return 1.0
    if max_terms is not None:
        term = head = math.exp(-rate)
        for k in range(1, min(n - 1, max_terms) + 1):
            term *= rate / k
            head += term
        return max(0.0, 1.0 - head)
    if n > rate:
        term, tail, k = math.exp(n * math.log(rate) - rate - math.lgamma(n + 1)), 0.0, n
        while term > tail * 1e-17:
            tail, k = tail + term, k + 1
            term *= rate / k
        return tail
    term, head, k = math.exp((n - 1) * math.log(rate) - rate - math.lgamma(n)), 0.0, n - 1
    while k >= 0 and term > head * 1e-17:
        head += term
        term, k = term * k / rate, k - 1
    return max(0.0, 1.0 - head)


def firing_count(history: list[int], params: Params = DEFAULTS) -> int | None:
    """The smallest count of an hour at which the active detector fires after this history, if any.

    Every score grows with the count, so a bound is doubled until it fires and then halved in on.
    """
    if len(history) < params.min_history_hours:
        return None
    mean = sum(map(float, history)) / len(history) if history else 0.0
    if params.active_detector == "ewma":
        level = float(history[0]) if history else 0.0
        for x in history[1:]:
            level = params.ewma_alpha * x + (1 - params.ewma_alpha) * level
        level = max(level, params.ewma_floor)

        def fires(n: int) -> bool:
            return n / level > params.ewma_multiplier
    elif params.active_detector == "zscore":
        squares = 0.0
        for x in history:
            squares += (x - mean) * (x - mean)
        spread = max(math.sqrt(squares / (len(history) - 1)) if len(history) > 1 else 0.0, params.z_sigma_floor)

        def fires(n: int) -> bool:
            return (n - mean) / spread > params.z_threshold
    elif params.active_detector == "poisson":
        rate = max(mean, params.poisson_lambda_floor)
        if params.poisson_max_terms is not None and _poisson_tail(
                params.poisson_max_terms + 1, rate, params.poisson_max_terms) >= params.poisson_probability:
            return None  # past the last term the tail no longer moves

        def fires(n: int) -> bool:
            return _poisson_tail(n, rate, params.poisson_max_terms) < params.poisson_probability
    else:
        raise ValueError(f"unknown detector {params.active_detector}")
    quiet, loud = params.min_observed - 1, params.min_observed
    while not fires(loud):
        quiet, loud = loud, 2 * loud
    while loud - quiet > 1:
        middle = (quiet + loud) // 2
        quiet, loud = (quiet, middle) if fires(middle) else (middle, loud)
    return loud


class Facts(NamedTuple):
    """What a group is known by: first event, events while young, status and since when, judged until."""

    born: int | None = None
    young: int = 0
    status: str = "open"
    since: int = 0
    parts: int = 0
    done: int = 0


_FACTS = T.StructType([
    T.StructField("born", T.LongType()), T.StructField("young", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("since", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("done", T.LongType())])
_PART = T.StructType([T.StructField("us", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.StringType())),
                      T.StructField("statuses", T.ArrayType(T.StringType()))])


def _struct(name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind)])


class AlertProcessor(StatefulProcessor):
    """Per group: rows waiting for the watermark, counts of the last hours, last alert per kind, facts.

    Rows wait until the watermark has passed them (a timer for the oldest of each part) and are
    then judged in the order of time, so what a group
    raises does not depend on how its rows were cut into batches. A row older than what its group was
    already judged for is reported as late and changes nothing. The state of a group is its history
    window, one entry per kind and the rows of the watermark's delay: it does not grow with time.
    """

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _struct("part", T.LongType()), _PART)
        self.hours = handle.getMapState("hours", _struct("hour", T.LongType()), _struct("n", T.LongType()))
        self.last = handle.getMapState("last", _struct("kind", T.StringType()), _struct("us", T.LongType()))
        self.facts = handle.getValueState("facts", _FACTS)

    def _facts(self) -> Facts:
        return Facts(*self.facts.get()) if self.facts.exists() else Facts()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts = self._facts()
        for part in rows:
            behind = part["us"] < facts.done
            if behind.any():
                yield _made(key[0], [(LATE, us, i) for us, i in zip(part["us"][behind], part["event_id"][behind], strict=True)])
                part = part[~behind]
            if len(part):
                self.waiting.updateValue((facts.parts,), (
                    part["us"].tolist(), part["event_id"].tolist(),
                    [None if pd.isna(s) else s for s in part["status"]]))
                facts = facts._replace(parts=facts.parts + 1)
                self.handle.registerTimer(int(part["us"].min()) // 1000 + 1)
        self.facts.update(tuple(facts))

    def _due(self, now: int) -> list[tuple[int, bool, str, str | None]]:
        """Takes the waiting rows before ``now``, in order; a change comes before the events of its instant."""
        due = []
        for (part,), (us, ids, statuses) in list(self.waiting.iterator()):
            ripe = np.asarray(us) < now
            if not ripe.any():
                continue
            due += [(u, s is None, i, s) for u, i, s, r in zip(us, ids, statuses, ripe, strict=True) if r]
            if ripe.all():
                self.waiting.removeKey((part,))
            else:
                left = np.flatnonzero(~ripe)
                self.waiting.updateValue((part,), tuple([x[i] for i in left] for x in (us, ids, statuses)))
                self.handle.registerTimer(min(us[i] for i in left) // 1000 + 1)
        return sorted(due, key=lambda r: (r[0], r[1], r[2] or ""))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        facts = self._facts()
        due = self._due(now)
        if due:
            found, facts = self._judge(due, facts._replace(done=now))
            self.facts.update(tuple(facts))
            if found:
                yield _made(key[0], found)

    def _judge(self, due: list[tuple[int, bool, str, str | None]], facts: Facts) -> tuple[list[tuple], Facts]:
        p = self.params
        counts = {h: n for (h,), (n,) in self.hours.iterator()}
        last = {k: us for (k,), (us,) in self.last.iterator()}
        born, young, status, since = facts.born, facts.young, facts.status, facts.since
        found, hour, threshold = [], None, None

        def ask(kind: str, us: int, event_id: str) -> None:
            if kind not in last or us >= last[kind] + p.cooldown_for(kind) * 60_000_000:
                last[kind] = us
                self.last.updateValue((kind,), (us,))
                found.append((kind, us, event_id))

        for us, is_event, event_id, change in due:
            if not is_event:
                status, since = change, us
                continue
            born = us if born is None else born
            if us // HOUR_US != hour:
                hour = us // HOUR_US
                start = max(born // HOUR_US, hour - p.history_hours)
                threshold = firing_count([counts.get(h, 0) for h in range(start, hour)], p)
            counts[hour] = counts.get(hour, 0) + 1
            if (us - born) // HOUR_US <= p.new_group_window_hours:
                young += 1
                if young >= p.new_group_threshold:
                    ask("new_group", us, event_id)
            if status == "resolved" and us > since:
                status = "regressed"
                ask("regression", us, event_id)
            if threshold is not None and counts[hour] >= threshold:
                ask("spike", us, event_id)
        self._keep_hours(counts, hour)
        return found, facts._replace(born=born, young=young, status=status, since=since)

    def _keep_hours(self, counts: dict[int, int], hour: int | None) -> None:
        if hour is None:
            return
        for h, n in counts.items():
            if h < hour - self.params.history_hours:
                self.hours.removeKey((h,))
            else:
                self.hours.updateValue((h,), (n,))

    def close(self) -> None:
        pass


def _made(group_id: str, found: list[tuple[str, int, str]]) -> pd.DataFrame:
    kinds, us, ids = zip(*found, strict=True)
    return pd.DataFrame({"group_id": group_id, "kind": kinds, "at": pd.to_datetime(np.array(us), unit="us"), "event_id": ids})


def with_changes(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events and status changes (group_id, changed_at, status) as one feed, in batch and stream."""
    return (events.select("group_id", "received_at", "event_id", F.lit(None).cast("string").alias("status"))
            .unionByName(changes.select("group_id", F.col("changed_at").alias("received_at"),
                                        F.lit("").alias("event_id"), "status")))


def alert_stream(feed: DataFrame, watermark: str = "10 minutes", params: Params = DEFAULTS) -> DataFrame:
    """(group_id, kind, at, event_id) as alerts are due, and ``late`` rows, from a feed of ``with_changes``.

    Kinds, cooldowns and ties are those of the batch operators. A group's rows pass one task in
    Arrow batches; its state lies in RocksDB.
    """
    use_rocksdb(feed.sparkSession)
    rows = (feed.withWatermark("received_at", watermark)
            .select("group_id", F.unix_micros("received_at").alias("us"), "event_id", "status"))
    return rows.groupBy("group_id").transformWithStateInPandas(
        statefulProcessor=AlertProcessor(params), outputStructType=ALERT_SCHEMA, outputMode="Append",
        timeMode="EventTime")


def alerts_of(written: DataFrame) -> DataFrame:
    return written.filter(F.col("kind") != LATE)


def late_rows(written: DataFrame) -> DataFrame:
    return written.filter(F.col("kind") == LATE).drop("kind")
