"""Finding the n-th event of a key without ranking the whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultsift.session import cut


ID_STEP = 4  # leading characters by which a cell of one microsecond is narrowed at a time
LAST_CELL = 10_000  # events of a cell that are ranked together


def locate_nth(events: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Order position of the n-th event by (received_at, event_id) for each target key.

    ``targets`` holds ``keys`` (ending in an hour) and ``n``; the result has keys, n, ``nth_at``
    and ``nth_id``. It is found by narrowing down: events per second of the hour are counted, then
    per microsecond of the second in which n falls, then per id prefix, four characters
    longer each time, until the cell is small. Counts combine map-side, each running sum covers at
    most 3600, a million and a prefix alphabet's worth of rows, and only the last cell's
    events are ranked. A key, an hour, a second or a prefix that holds a third of all rows
    therefore never meets in one task.
    """
    targets = targets.select(*keys, "n")
    rows = events.select(*keys, "received_at", "event_id")
    wanted = rows.join(targets.select(*keys), keys, "left_semi")
    coarse = _narrow(wanted, targets.select(*keys, F.col("n").alias("_left")), keys,
                     F.unix_seconds("received_at"))
    # One second per key is left: write it down rather than scan the events again.
    cell = cut(coarse)
    cell = cut(_narrow(cell.drop("_left"), cell.select(*keys, "_left").distinct(), keys,
                       F.unix_micros("received_at")))
    prefix = 0
    while True:
        sizes = cell.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                        F.max(F.length("event_id")).alias("_length"))
        large = sizes.filter((F.col("_n") > LAST_CELL) & (F.col("_length") > prefix))
        if large.isEmpty():
            break
        prefix += ID_STEP
        cell = cut(_narrow(cell.drop("_left"), cell.select(*keys, "_left").distinct(), keys,
                           F.substring("event_id", 1, prefix)))
    order = Window.partitionBy(*keys).orderBy("event_id")
    return (cell.withColumn("_rn", F.row_number().over(order))
            .filter(F.col("_rn") == F.col("_left"))
            .join(targets, keys)
            .select(*keys, "n", F.col("received_at").alias("nth_at"),
                    F.col("event_id").alias("nth_id")))


def _narrow(rows: DataFrame, targets: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    """The rows of the cell in which each target's ``_left``-th row falls, and its rank there."""
    celled = rows.withColumn("_cell", cell)
    counts = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_cnt"))
    running = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    crossing = (counts.withColumn("_cum", F.sum("_cnt").over(running))
                .join(targets, keys)
                .filter((F.col("_cum") >= F.col("_left"))
                        & (F.col("_cum") - F.col("_cnt") < F.col("_left")))
                .select(*keys, "_cell", (F.col("_left") - F.col("_cum") + F.col("_cnt"))
                        .alias("_left")))
    return celled.join(crossing, [*keys, "_cell"]).drop("_cell")


def first_n(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n events per key; each map task keeps n rows per key before the exchange."""
    w = Window.partitionBy(*keys).orderBy("received_at", "event_id")
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
