"""Rollups at three widths (hour, day, month), kept by the same additive merge; reads take the widest that fit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.operators.ingest import merge_rollups
from faultsift.sources.versions import Part, VersionedTable

#: Width of a row -> what one partition spans.
LEVELS = {"hour": "day", "day": "month", "month": "year"}


def floor_to(at: dt.datetime, unit: str) -> dt.datetime:
    parts = {"hour": 4, "day": 3, "month": 2, "year": 1}[unit]
    return dt.datetime(*(at.timetuple()[:parts] + (1,) * max(0, 3 - parts)))


def step(at: dt.datetime, unit: str) -> dt.datetime:
    """The start of the unit after the one that starts at ``at``."""
    if unit in ("hour", "day"):
        return at + dt.timedelta(**{f"{unit}s": 1})
    months = at.year * 12 + at.month - 1 + (12 if unit == "year" else 1)
    return dt.datetime(months // 12, months % 12 + 1, 1)


def tiles(since: dt.datetime, until: dt.datetime, widest: str = "month") -> list[tuple[str, dt.datetime, dt.datetime]]:
    """Stretches (level, start, end) that cover [since, until) of full hours without overlap, each of the
    widest level that fits, ``widest`` at most: at most five of them."""
    order = list(LEVELS)
    for level in reversed(order[:order.index(widest) + 1]):
        first = floor_to(since, level)
        first = first if first == since else step(first, level)
        last = floor_to(until, level)
        if first < last:
            return tiles(since, first, level) + [(level, first, last)] + tiles(last, until, level)
    return []


class Pyramid:
    """The three rollup tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.tables = {level: VersionedTable(spark, f"{path}/{level}", span, F.date_format(
            "bucket_start", {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[span]), "bucket_start")
            for level, span in LEVELS.items()}

    def merge(self, hourly: DataFrame, source: str | None = None, batch: int | None = None) -> None:
        """Adds hourly counts to every level. A batch that was applied before changes nothing; one that broke off
        between levels is completed when it comes again."""
        for level, table in self.tables.items():
            if table.done(source, batch):
                continue
            rows = hourly if level == "hour" else (
                hourly.groupBy("group_id", F.date_trunc(level, "bucket_start").alias("bucket_start"))
                .agg(F.sum("event_count").alias("event_count")))
            table.merge(rows.select("group_id", "bucket_start", "event_count"), merge_rollups, source, batch)

    def read(self, since: dt.datetime | None = None, until: dt.datetime | None = None, widest: str = "hour") -> DataFrame:
        """(group_id, bucket_start, event_count) of [since, until), rows no wider than ``widest``; without
        bounds the whole table of that level. Partitions outside are not opened."""
        if since is None or until is None:
            return self.tables[widest].read()
        out = None
        for level, first, last in tiles(since, until, widest):
            df = self.tables[level].read(self._overlapping(first, last)).filter(
                (F.col("bucket_start") >= F.lit(first)) & (F.col("bucket_start") < F.lit(last)))
            out = df if out is None else out.unionByName(df)
        return self.tables["hour"].read(lambda *_: False) if out is None else out

    @staticmethod
    def _overlapping(first: dt.datetime, last: dt.datetime):
        low, high = f"{first:%Y-%m-%d %H:%M:%S}", f"{last:%Y-%m-%d %H:%M:%S}"

        def wanted(_: str, part: Part) -> bool:
            return part.high >= low and part.low < high

        return wanted
