"""Request metrics over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainscope.operators.fleet import _status
from trainscope.schemas import METRICS_INTERVAL

#: Windows of one block of a running total.
BLOCK = 1024


def stream_request_metrics(rpc: DataFrame, lateness: str, interval: str = METRICS_INTERVAL, heartbeat: DataFrame | None = None) -> DataFrame:
    """Requests per push interval, method and status.

    A window is sent out once the watermark has passed its end.  ``heartbeat`` is a stream with a ``ts`` column
    that moves the watermark when no requests come, so that the last windows are sent too; it counts as no request.
    """
    asked = rpc.select("ts", "method", _status().alias("status"), F.lit(1).alias("asked"))
    if heartbeat is not None:
        none = F.lit(None).cast("string")
        asked = asked.unionByName(heartbeat.select("ts", none.alias("method"), none.alias("status"), F.lit(0).alias("asked")))
    # The test is on a sum, not on a column, so it cannot move below the watermark.
    return (asked.withWatermark("ts", lateness).groupBy(F.window("ts", interval), "method", "status")
            .agg(F.sum("asked").alias("requests")).filter("requests > 0")
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"),
                    "method", "status", "requests"))


def running_totals(windows: DataFrame) -> DataFrame:
    """The ever-growing counter, from the stored window counts.

    Totals run inside blocks of ``BLOCK`` windows, and over the sums of the blocks before; so one task sees a
    block, or one row for each block, and never the whole history of a method.
    """
    width = F.unix_seconds("end") - F.unix_seconds("start")
    blocked = windows.withColumn("_block", F.floor(F.unix_seconds("start") / (width * BLOCK)))
    keys = ["method", "status"]
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*keys, "_block").agg(F.sum("requests").alias("_sum"))
    before = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(*keys, "_block").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (blocked.withColumn("_own", F.sum("requests").over(upto)).join(before, [*keys, "_block"])
            .withColumn("total", F.col("_before") + F.col("_own")).drop("_block", "_own", "_before"))
