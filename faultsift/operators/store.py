"""The written event store: days of events, and Bloom filters that say which days may hold an id."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.contracts import DEFAULTS, Params
from faultsift.functions.fingerprint import with_fingerprint
from faultsift.operators import ingest
from faultsift.sources.versions import Part, VersionedTable, daily

SEGMENT = 32_768  # bits that one bitmap row holds
BITS_PER_ID, HASHES = 16, 4  # one id in 400 looks stored on a day that does not hold it


def _segments(rows: int) -> int:
    return max(1, -(-BITS_PER_ID * rows // SEGMENT))


def _segment(size: Column) -> Column:
    """All bits of an id lie in one segment, so one row of a filter answers for it."""
    return F.pmod(F.xxhash64("event_id", F.lit(HASHES)), size)


def _bits() -> list[Column]:
    return [F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(SEGMENT)) for i in range(HASHES)]


class EventStore:
    """Events by day, each id once, however late it comes again.

    A day's filter is made from the day's folder and named after it. A filter that is missing or belongs to an
    earlier folder makes its day one that may hold any id, so a change that broke off costs a read and no result.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.events = daily(spark, f"{path}/events", "received_at")
        self.filters = VersionedTable(spark, f"{path}/filters", "part", F.col("of"), counted=False)
        self.days_read: list[str] = []

    @staticmethod
    def _filter_name(day: str, part: Part) -> str:
        return f"{day}.{part.path.rsplit('/v=', 1)[1].split('/')[0]}"

    def refresh(self) -> None:
        """Makes the filters that are missing and drops those of folders that are gone."""
        parts = self.events.manifest().parts
        wanted = {self._filter_name(d, p): (d, p) for d, p in parts.items()}
        known = set(self.filters.manifest().parts)
        fresh = {n: v for n, v in wanted.items() if n not in known}
        if not fresh and known <= set(wanted):
            return
        rows = None
        if fresh:
            sizes = self.spark.createDataFrame(
                [(d, n, _segments(p.rows)) for n, (d, p) in fresh.items()], "_day string, of string, size long")
            days = {d for d, _ in fresh.values()}
            ids = self.events.read(lambda d, _: d in days).select(
                "event_id", F.to_date("received_at").cast("string").alias("_day"))
            rows = (ids.join(sizes, "_day")
                    .select("of", "size", _segment(F.col("size")).alias("segment"), F.explode(F.array(*_bits())).alias("_bit"))
                    .groupBy("of", "size", "segment").agg(F.bitmap_construct_agg("_bit").alias("bits")))
        else:
            rows = self.filters.read(lambda *_: False)
        self.filters.replace(rows, touched=list(fresh), drop=[n for n in known if n not in wanted])

    def days_that_may_hold(self, ids: DataFrame) -> list[str]:
        """The stored days of which the filters cannot say that they hold none of the ids."""
        parts = self.events.manifest().parts
        made = self.filters.manifest()
        names = {self._filter_name(d, p): (d, p) for d, p in parts.items()}
        certain = [d for n, (d, _) in names.items() if n not in made.parts]
        sizes = sorted({_segments(p.rows) for n, (_, p) in names.items() if n in made.parts})
        if not sizes:
            return sorted(certain)
        probes = (ids.select("event_id").distinct()
                  .select("event_id", F.explode(F.array(*[F.lit(n).cast("bigint") for n in sizes])).alias("size"))
                  .withColumn("segment", _segment(F.col("size"))))
        bitmaps = self.filters.read(lambda n, _: n in names, made)

        def is_set(bit: Column) -> Column:
            byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.call_function("shiftright", byte, (bit % 8).cast("int")) % 2 == 1

        hit = (probes.join(bitmaps, ["size", "segment"]).filter(reduce(Column.__and__, map(is_set, _bits())))
               .select("of").distinct().collect())
        return sorted(certain + [names[r["of"]][0] for r in hit])

    def fresh(self, df: DataFrame) -> DataFrame:
        """The rows whose id is not stored. Only days that may hold one are read."""
        if self.events.manifest().schema is None:
            return df
        self.days_read = self.days_that_may_hold(df)
        if not self.days_read:
            return df
        days = set(self.days_read)
        return ingest.not_yet_stored(df, self.events.read(lambda d, _: d in days))

    def ingest(self, raw: DataFrame, params: Params = DEFAULTS, source: str | None = None,
               batch: int | None = None) -> DataFrame:
        """Stores the valid, new events of ``raw`` and returns them. A batch that comes again adds nothing.

        Raw records are kept and laid out by day; their frames are read on the way into the table, so what is
        derived is written once and not shuffled. The events returned are those of the table.
        """
        if self.events.done(source, batch):
            self.refresh()
            return self.events.read(lambda *_: False)
        valid, _ = ingest.split_valid(ingest.assign_event_ids(raw))
        unique = self._kept(ingest.deduplicate(valid))
        fresh = self.fresh(unique)
        if fresh is not unique:
            fresh = self._kept(fresh)
        days = self.events.touched_by(fresh)
        laid = fresh.withColumn("_day", self.events.value).hint("rebalance", "_day").drop("_day")
        stored = with_fingerprint(ingest.resolve_legacy(laid), params.fingerprint_version)
        self.events.merge(stored, DataFrame.unionByName, source, batch, days, dealt=True)
        self.refresh()
        among = set(days)
        return (self.events.read(lambda d, _: d in among).join(fresh.select("event_id"), "event_id", "left_semi")
                .select(*stored.columns))

    def _kept(self, df: DataFrame) -> DataFrame:
        """Raw records of a batch, compressed and by column, as it has them until ``forget``."""
        path = f"{self.path}/batches/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        """Deletes the raw records of all batches; what ``ingest`` returned cannot be read after that."""
        fs, target = self.events._fs(f"{self.path}/batches")
        fs.delete(target, True)
