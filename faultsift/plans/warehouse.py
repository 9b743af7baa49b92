"""The derived tables, written once per input folder and read back by every query.

Raw feed -> stored events -> rollups, groups, observations, alerts, in the shared folder
named by ``spark.checkpoint.dir``. Written tables cut lineage: a lost executor costs the
tasks that ran on it, not the pipeline behind them.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, EVENT_COLUMNS, Params
from faultsift.operators import alerts, detect, ingest, lifecycle
from faultsift.operators.pyramid import Pyramid
from faultsift.operators.similar import TitleIndex
from faultsift.session import prepare_session, scratch_path
from faultsift.sources import sinks, tables
from faultsift.sources.versions import VersionedTable, daily

AS_OF = dt.datetime(2024, 1, 31)
# The test tables are small: two thresholds are lowered so that the rules have work to do.
PARAMS = dataclasses.replace(DEFAULTS, hourly_cap=3, new_group_threshold=4)

FEED_ROWS = 50_000  # given rows a file of the feed is made of

_ROOTS: dict[tuple[str, str], str] = {}


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = PARAMS):
        self.spark = prepare_session(spark)
        self.sf_dir = sf_dir
        self.params = params
        key = (spark.sparkContext.applicationId, sf_dir)
        self.root = _ROOTS.setdefault(key, scratch_path(spark, "tables"))

    def _table(self, name: str, build: Callable[[], DataFrame], since=None, dealt: bool = False) -> DataFrame:
        if not sinks.has_table(self.spark, self.root, name):
            sinks.write_table(build(), self.root, name, dealt=dealt)
        return sinks.read_table(self.spark, self.root, name, since)

    def source(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    def raw(self) -> DataFrame:
        """The error feed as it arrives: duplicates, invalid records and all."""
        def build() -> DataFrame:
            given = self.source("events")
            return tables.fault_feed(given.repartition(1 + given.count() // FEED_ROWS))

        return self._table("raw", build, dealt=True)

    def events(self) -> DataFrame:
        """Valid, de-duplicated, fingerprinted events, as they come in."""
        return self._table("events", lambda: ingest.store(self.raw(), self.params, by_day=True), dealt=True)

    def days(self, name: str, column: str) -> VersionedTable:
        """A derived table once more, as a versioned table of days of ``column``."""
        table = daily(self.spark, f"{self.root}/{name}_days", column)
        if not table.versions():
            table.replace(getattr(self, name)())
        return table

    def event_days(self) -> VersionedTable:
        return self.days("events", "received_at")

    def part_names(self) -> TitleIndex:
        index = TitleIndex(self.spark, f"{self.root}/part_names")
        if not index.table.versions():
            index.add(self.source("part"), "p_partkey", "p_name")
        return index

    def stored(self) -> DataFrame:
        """Events as they are kept: past the hourly cap without trace and payload, marked ``sampled``. What is
        derived from a record (frames, normal forms, title) is in ``events`` and not written again."""
        return self._table("stored", lambda: ingest.apply_hourly_cap(
            self.events().select(*EVENT_COLUMNS, "resolved_platform", "fingerprint", "fingerprint_version", "group_id"),
            self.rollups(), self.params.hourly_cap))

    def rollups(self, since: dt.datetime | None = None) -> DataFrame:
        """Hourly counts; ``since`` reads only the date folders from there on."""
        return self._table("rollups", lambda: ingest.rollup(self.events()), since)

    def pyramid(self) -> Pyramid:
        """The hourly counts again by hour, day and month."""
        pyramid = Pyramid(self.spark, f"{self.root}/pyramid")
        pyramid.merge(self.rollups(), "rollups", 0)
        return pyramid

    def groups(self) -> DataFrame:
        return self._table("groups", lambda: ingest.build_groups(
            self.events(), self.params.hourly_cap, self.rollups()))

    # -- the status log, made of the groups themselves --------------------------------------
    def status_log(self) -> DataFrame:
        return tables.status_log(self.groups())

    def intervals(self) -> DataFrame:
        return self._table("intervals", lambda: lifecycle.status_intervals(
            self.status_log(), self.groups(), self.events()))

    def comebacks(self) -> DataFrame:
        return self._table("comebacks",
                           lambda: lifecycle.regressions(self.intervals(), self.events()))

    def states(self) -> DataFrame:
        return self._table("states", lambda: lifecycle.group_states(
            self.groups(), self.intervals(), self.comebacks(), as_of()))

    def timeline(self) -> DataFrame:
        return lifecycle.status_timeline(self.intervals(), self.comebacks())

    def observations(self) -> DataFrame:
        return self._table("observations", lambda: detect.score(
            detect.observe(self.rollups(), self.params),
            detect.hindsight(self.rollups(), self.params), as_of(), self.params))

    def alerts(self) -> DataFrame:
        return self._table("alerts", lambda: alerts.all_alerts(
            self.events(), self.rollups(), self.groups(), self.comebacks(), self.timeline(),
            self.params))

    def attempts(self) -> DataFrame:
        return tables.attempt_log(self.alerts())

    def delivered_alerts(self) -> DataFrame:
        return alerts.fold_deliveries(self.alerts(), self.attempts(), self.params)
