"""Hang detection over a stream of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainscope.functions.logs import log_entry
from trainscope.schemas import DEFAULT_HANG_SECONDS


def stream_hang_detection(lines: DataFrame, lateness: str, threshold: int = DEFAULT_HANG_SECONDS,
                          heartbeat: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """One row each time a rank has been silent for more than ``threshold`` seconds.

    Silence is measured in whole seconds and must exceed the threshold, so lines
    less than ``threshold + 1`` seconds apart form one session; sessions that
    just touch are merged, hence the missing microsecond.  In append mode the session is sent out once the watermark
    has passed its end.  ``lateness`` must cover the time by which files of one
    rank may arrive after those of another, or ranks seem silent that are not.
    ``heartbeat`` is a stream with a ``ts`` column that
    moves the watermark when every rank is silent; it adds no rows.  ``expected`` is a stream of
    ``node, rank, ts``: ranks that should speak from then on.  One that does not is silent since that time,
    with 0 lines, also if it never speaks at all.
    """
    entry = log_entry("line")
    mark = lambda spoke, due: (F.lit(spoke).alias("spoke"), F.lit(due).alias("due"))
    spoken = (lines.select("node", "rank", entry.alias("e"))
              .select("node", "rank", F.col("e.ts").alias("ts"), *mark(1, 0)).filter("ts is not null"))
    if heartbeat is not None:
        spoken = spoken.unionByName(heartbeat.select(F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("rank"),
                                                     "ts", *mark(0, 0)))
    if expected is not None:
        spoken = spoken.unionByName(expected.select("node", "rank", "ts", *mark(0, 1)))
    session = F.session_window("ts", f"{threshold} seconds 999999 microseconds")
    # The test is on sums, not on the rank, so it cannot move below the watermark.
    return (spoken.withWatermark("ts", lateness).groupBy("node", "rank", session)
            .agg(F.max("ts").alias("last_line"), F.sum("spoke").alias("lines"), F.sum("due").alias("due"))
            .filter("lines > 0 or due > 0").select("node", "rank", "last_line", "lines"))
