"""Tables of whole partitions: a change writes the partitions it touches aside and switches one manifest."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclasses.dataclass(frozen=True)
class Part:
    """One partition of one version: its folder, rows, and the range of the table's ``order`` column."""

    path: str
    rows: int
    low: str | None = None
    high: str | None = None


@dataclasses.dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str | None = None
    parts: dict[str, Part] = dataclasses.field(default_factory=dict)
    applied: dict[str, int] = dataclasses.field(default_factory=dict)


class VersionedTable:
    """Parquet under ``path``, partitioned by ``name`` = ``value`` of a row (a day, a bucket), by ``sort`` within.
    Values are plain names. Where rows are not ``counted``, a change saves a look at what it wrote.

    A version is a manifest: the folder of every partition, its rows and the range of ``order``. A change writes
    the touched partitions into a folder of its own and then renames one manifest into place, so a reader
    has either version as a whole, and a driver lost half-way leaves the old one. There is one writer at a
    time. Partitions are bounded by the calendar or a fixed number of buckets; their manifest is all that
    the driver reads.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, value: Column, order: str | None = None,
                 sort: str | None = None, counted: bool = True):
        self.spark, self.path, self.name, self.value = spark, path.rstrip("/"), name, value
        self.order, self.sort, self.counted = order, sort, counted
        self._jvm = spark.sparkContext._jvm
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    # -- manifests ----------------------------------------------------------------------------------
    def _fs(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._hadoop), target

    def _names(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known:
            return Manifest()
        fs, target = self._fs(f"{self.path}/manifests/{known[-1] if version is None else version:012d}.json")
        stream = fs.open(target)
        try:
            told = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(**{**told, "parts": {k: Part(**p) for k, p in told["parts"].items()}})

    def _switch(self, manifest: Manifest) -> None:
        final = f"{self.path}/manifests/{manifest.version:012d}.json"
        fs, aside = self._fs(f"{final}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(dataclasses.asdict(manifest)), "utf-8"))
        stream.close()
        _, target = self._fs(final)
        if fs.exists(target) or not fs.rename(aside, target):
            raise RuntimeError(f"another writer made version {manifest.version} of {self.path}")

    # -- reading ------------------------------------------------------------------------------------
    def read(self, wanted: Callable[[str, Part], bool] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The rows of the partitions for which ``wanted(value, part)`` holds; all without it."""
        manifest = manifest or self.manifest()
        if manifest.schema is None:
            raise ValueError(f"{self.path} has no version yet")
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        folders: dict[str, list[str]] = {}
        for value, part in manifest.parts.items():
            if wanted is None or wanted(value, part):
                base = part.path.rsplit("/v=", 1)[0]
                folders.setdefault(base, []).append(part.path)
        plain = [f.name for f in schema if f.name != self.name]
        if not folders:
            return self.spark.createDataFrame([], schema).select(*plain)
        out = None
        for base, paths in folders.items():
            df = self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*plain)
            out = df if out is None else out.unionByName(df)
        return out

    # -- writing ------------------------------------------------------------------------------------
    def done(self, source: str | None, batch: int | None) -> bool:
        return source is not None and self.manifest().applied.get(source, -1) >= batch

    def replace(self, df: DataFrame, touched: list[str] | None = None, drop: list[str] = (),
                source: str | None = None, batch: int | None = None, dealt: bool = False) -> Manifest:
        """Puts ``df`` in the place of the partitions it has rows of, or of ``touched``, and drops others whole.

        Dropping alone moves no data. A ``batch`` of a ``source`` that was applied before changes nothing.
        ``dealt`` says that the rows already lie by partition and are not shuffled again.
        """
        old = self.manifest()
        if source is not None and old.applied.get(source, -1) >= batch:
            return old
        dated = df.withColumn(self.name, self.value)
        schema, parts = dated.schema, {k: p for k, p in old.parts.items() if k not in set(drop)}
        if touched is None or touched:
            base = f"{self.path}/data"
            # The ending keeps Spark from reading the version as a number.
            folder = f"{base}/v={old.version + 1}-{uuid.uuid4().hex[:8]}"
            laid = dated if dealt else dated.hint("rebalance", self.name)
            if self.sort:  # files in order: a filter on the column skips row groups
                laid = laid.sortWithinPartitions(self.name, self.sort)
            laid.write.partitionBy(self.name).parquet(folder)
            made = self._measured(schema, base, folder)
            parts = {k: p for k, p in parts.items() if k not in set(touched or made)} | made
        new = Manifest(old.version + 1, schema.json(), parts,
                       old.applied | ({source: batch} if source is not None else {}))
        self._switch(new)
        return new

    def _measured(self, schema: T.StructType, base: str, folder: str) -> dict[str, Part]:
        fs, target = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]
        if not names:
            return {}
        if not self.counted:
            return {n.split("=", 1)[1]: Part(f"{folder}/{n}", -1) for n in names}
        written = self.spark.read.schema(schema).parquet(folder)
        bounds = [F.min(self.order).cast("string"), F.max(self.order).cast("string")] if self.order else [F.lit(None)] * 2
        rows = written.groupBy(F.col(self.name).cast("string")).agg(F.count(F.lit(1)), *bounds).collect()
        return {r[0]: Part(f"{folder}/{self.name}={r[0]}", *tuple(r)[1:]) for r in rows}

    def touched_by(self, df: DataFrame) -> list[str]:
        return [r[0] for r in df.select(self.value.cast("string").alias("p")).distinct().collect()]

    def merge(self, new: DataFrame, merge: Merge, source: str | None = None, batch: int | None = None,
              touched: list[str] | None = None, dealt: bool = False) -> Manifest:
        """Folds ``new`` into the partitions it touches, those of ``touched`` if they are known; the others keep
        their folders. ``dealt`` is as for ``replace``."""
        manifest = self.manifest()
        if source is not None and manifest.applied.get(source, -1) >= batch:
            return manifest
        touched = self.touched_by(new) if touched is None else touched
        if manifest.schema is None:
            return self.replace(new, source=source, batch=batch, dealt=dealt)
        known = [t for t in touched if t in manifest.parts]
        merged = merge(self.read(lambda v, _: v in set(known), manifest), new) if known else new
        return self.replace(merged, touched, source=source, batch=batch, dealt=dealt)

    def clone(self, path: str) -> VersionedTable:
        """A table of its own that starts from this one's folders; nothing is copied, and neither sees the other's changes."""
        other = VersionedTable(self.spark, path, self.name, self.value, self.order, self.sort, self.counted)
        other._switch(dataclasses.replace(self.manifest(), version=1))
        return other

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests before the last ``keep`` and the folders that none of those names; how many folders went."""
        versions = self.versions()
        for version in versions[:-keep]:
            fs, target = self._fs(f"{self.path}/manifests/{version:012d}.json")
            fs.delete(target, False)
        held = {p.path for v in versions[-keep:] for p in self.manifest(v).parts.values()}
        gone = 0
        for version in self._names(f"{self.path}/data"):
            folder = f"{self.path}/data/{version}"
            inner = [n for n in self._names(folder) if n.startswith(f"{self.name}=")]
            stale = [n for n in inner if f"{folder}/{n}" not in held]
            for n in stale if len(stale) < len(inner) else [None]:
                fs, target = self._fs(folder if n is None else f"{folder}/{n}")
                fs.delete(target, True)
            gone += len(stale)
        return gone

    def stored_bytes(self) -> int:
        """Size of the current version from the file listing; no data is read."""
        total = 0
        for part in self.manifest().parts.values():
            fs, target = self._fs(part.path)
            total += fs.getContentSummary(target).getLength()
        return total


def daily(spark: SparkSession, path: str, column: str) -> VersionedTable:
    """One partition a day of ``column``, its range known."""
    return VersionedTable(spark, path, "day", F.to_date(column), column)


def bucketed(spark: SparkSession, path: str, key: str, buckets: int = 32) -> VersionedTable:
    """``buckets`` partitions by a hash of ``key``: equal keys of all versions share one."""
    return VersionedTable(spark, path, "bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), counted=False)
