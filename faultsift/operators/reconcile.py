"""Planned against delivered traffic per service and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.operators.ingest import hour_of

# -- I1 -------------------------------------------------------------------------------------------
def delivered(rollups: DataFrame, groups: DataFrame) -> DataFrame:
    return (rollups.join(groups.select("group_id", "service"), "group_id")
            .groupBy("service", F.col("bucket_start").alias("hour"))
            .agg(F.sum("event_count").alias("delivered")))


def delivered_by_service(records: DataFrame) -> DataFrame:
    """The same of accepted records themselves. A fingerprint holds its service, so groups are not needed to
    tell services apart, and no frame is read."""
    return (records.groupBy("service", hour_of().alias("hour"))
            .agg(F.count(F.lit(1)).alias("delivered")))


# -- I2 -------------------------------------------------------------------------------------------
def remainder(plan: DataFrame, actual: DataFrame) -> DataFrame:
    """What is still owed per planned (service, hour); finished hours drop out."""
    return (plan.join(actual, ["service", "hour"], "left")
            .withColumn("delivered", F.coalesce("delivered", F.lit(0)))
            .withColumn("owed", F.col("planned") - F.col("delivered"))
            .filter(F.col("owed") > 0))


# -- I3 -------------------------------------------------------------------------------------------
def drift(plan: DataFrame, actual: DataFrame) -> DataFrame:
    """State per planned hour: intact, or as its last mismatching service says.

    ``plan`` carries ``service_order``. Deliveries of unplanned services or hours are left
    out. Notes are listed in service order; there is one per service at most.
    """
    joined = (plan.join(actual, ["service", "hour"], "left")
              .withColumn("delivered", F.coalesce("delivered", F.lit(0))))
    off = F.col("delivered") != F.col("planned")
    state = F.when(F.col("delivered") > F.col("planned"), "over").otherwise("short")
    note = F.concat("service", F.lit(" "), F.col("delivered").cast("string"), F.lit("/"),
                    F.col("planned").cast("string"))
    noted = F.array_sort(F.collect_list(F.when(off, F.struct("service_order", note.alias("note")))))
    return (joined.groupBy("hour")
            .agg(F.max_by(F.when(off, state), F.when(off, F.col("service_order"))).alias("_state"),
                 noted.alias("_notes"))
            .select("hour", F.coalesce("_state", F.lit("intact")).alias("state"),
                    F.array_join(F.transform("_notes", lambda n: n["note"]), ", ").alias("notes")))
