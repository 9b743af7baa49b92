"""Parquet sinks for the derived tables.

Tables that grow with time are laid out by date, so that reads prune folders and a
re-run replaces only the dates it touched (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.session import cut

# table -> (date column, expression it is taken from)
DATED = {
    "events": "received_at",
    "stored": "received_at",
    "rollups": "bucket_start",
    "observations": "bucket_start",
    "alerts": "created_at",
    "sweeps": "ran_at",
}


def day_of(column: str) -> Column:
    return F.to_date(column)


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite", dealt: bool = False) -> str:
    """Write one derived table and return its path.

    The rebalance hint lets AQE split an over-full date and merge small ones; a plain
    repartition by date would send one busy day through one task. Rows that are ``dealt`` come laid
    out already.
    """
    path = f"{root}/{name}"
    if name in DATED:
        dated = df.withColumn("day", day_of(DATED[name]))
        # Static overwrite, also where the session says dynamic: only that leaves the
        # success marker which ``has_table`` looks for.
        ((dated if dealt else dated.hint("rebalance", "day")).write.mode(mode)
         .option("partitionOverwriteMode", "static").partitionBy("day").parquet(path))
    else:
        (df if dealt else df.hint("rebalance")).write.mode(mode).parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str, since=None, until=None) -> DataFrame:
    """Read a derived table; a half-open time range prunes its date folders."""
    df = spark.read.parquet(f"{root}/{name}")
    if name not in DATED:
        return df
    column = DATED[name]
    if since is not None:
        df = df.filter((F.col("day") >= F.to_date(F.lit(since))) & (F.col(column) >= F.lit(since)))
    if until is not None:
        df = df.filter((F.col("day") <= F.to_date(F.lit(until))) & (F.col(column) < F.lit(until)))
    return df.drop("day")


def merge_partitions(new: DataFrame, root: str, name: str, merge) -> None:
    """Fold new rows into the dates they touch, leaving other dates alone.

    The touched dates are a semi-join, not a collected list, and their first and last are a
    plain range that prunes date folders. The merged rows are written aside first: Spark must not
    read a folder that it is overwriting.
    """
    spark = new.sparkSession
    day = day_of(DATED[name])
    fresh = new.withColumn("day", day)
    first, last = fresh.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return
    target = f"{root}/{name}"
    if path_exists(spark, target):
        days = fresh.select("day").distinct()
        old = (spark.read.parquet(target).filter(F.col("day").between(F.lit(first), F.lit(last)))
               .join(days, "day", "left_semi"))
        fresh = merge(old.drop("day"), new).withColumn("day", day)
    cut(fresh).hint("rebalance", "day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)


def replacing(*keys: str):
    """A merge in which a new row takes the place of the stored row of the same keys."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)

    return merge


OBSERVATION_KEYS = ("group_id", "bucket_start", "detector")
ALERT_KEYS = ("alert_id",)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    """True when the table was written to its end."""
    return path_exists(spark, f"{root}/{name}/_SUCCESS")


def table_bytes(spark: SparkSession, root: str, name: str) -> int:
    """Stored size of a table from the file listing; no data is read."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0
