"""Rank logs: tails, silence and suspicion.

A log line table has ``node, rank, rank_no, line, line_no, file_mtime``;
``line_no`` is any sortable value that grows through a rank's file.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.functions.logs import entry_fields, line_head
from trainscope.functions.text import clean_utf8, extract_number, format_rfc3339, rank_label
from trainscope.operators.skew import spread_join, top_n
from trainscope.schemas import (
    DEFAULT_HANG_SECONDS, DEFAULT_TAIL_LINES, EARLIEST_VALID_TIME, MAX_LINE_BYTES, NO_TIME_SECONDS,
)

RANK_KEYS = ["node", "rank_no"]


def moment(value: Column | dt.datetime | str) -> Column:
    """A clock argument as a timestamp; naive values mean UTC."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        return F.lit(value)
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def tail_lines(lines: DataFrame, n: int = DEFAULT_TAIL_LINES) -> DataFrame:
    """Last ``n`` lines of each rank."""
    if n <= 0:
        raise ValueError("the number of lines must be positive")
    return top_n(lines, RANK_KEYS, [F.col("line_no").desc()], n)


def parse_log_lines(lines: DataFrame, zone: str | None = None, accept_short: bool = False,
                    keep_bad_time: bool = False) -> DataFrame:
    """Entries of the lines: adds ``ts, level, epoch, message``.

    Run this after ``tail_lines``: only the surviving lines are then parsed.
    ``keep_bad_time`` leaves dropped lines in, marked by ``kept = false``.
    """
    # The head is a column of its own, so its match is not repeated per field.
    headed = lines.withColumn("_head", line_head("line"))
    fields = entry_fields(F.col("line"), F.col("_head"), zone, accept_short)
    kept = (F.col("_head") == "") | F.col("ts").isNotNull()
    parsed = (headed.select(*lines.columns, "_head", *[c.alias(name) for name, c in fields.items()])
              .withColumn("kept", kept).drop("_head", "line"))
    return parsed if keep_bad_time else parsed.filter("kept").drop("kept")


def clean_messages(entries: DataFrame) -> DataFrame:
    return entries.withColumn("message", clean_utf8("message"))


def filter_rank_logs(df: DataFrame, rank: str | None = None) -> DataFrame:
    """One rank by its exact label; no label means all."""
    return df.filter(F.col("rank") == rank) if rank else df


def filter_rank_range(df: DataFrame, ranges: DataFrame, inclusive: bool = True) -> DataFrame:
    """Rows whose rank lies in its node's range; the top rank only if ``inclusive``."""
    bounds = ranges.select("node", F.col("min_rank").alias("_min"), F.col("max_rank").alias("_max"))
    top = F.col("rank_no") <= F.col("_max") if inclusive else F.col("rank_no") < F.col("_max")
    spread = "line_no" if "line_no" in df.columns else "rank_no"
    joined = spread_join(df, bounds, ["node"], [spread])
    return joined.filter((F.col("rank_no") >= F.col("_min")) & top).drop("_min", "_max")


def rank_status(entries: DataFrame, with_log: bool = False) -> DataFrame:
    """Per rank: entries kept, latest entry time and file time.

    Takes parsed lines with their ``kept`` mark.  The time is the maximum, not
    that of the last line.  ``with_log`` adds the entries themselves as ``log``,
    in file order; only for lines of ``tail_lines``, whose limit bounds the list.
    """
    facts = [
        F.count_if("kept").alias("entries"),
        F.max(F.when(F.col("kept"), F.col("ts"))).alias("last_entry"),
        F.max("file_mtime").alias("file_mtime"),
    ]
    if with_log:
        item = F.struct("line_no", _log_item(format_rfc3339("ts"), F.col("level"), F.col("epoch"), F.col("message")).alias("item"))
        facts.append(F.array_sort(F.collect_list(F.when(F.col("kept"), item))).alias("log"))
    status = entries.groupBy("node", "rank_no", "rank").agg(*facts)
    return status.withColumn("log", F.col("log.item")) if with_log else status


def _log_item(timestamp: Column, level: Column, epoch: Column, message: Column) -> Column:
    return F.struct(timestamp.alias("timestamp"), level.alias("level"), epoch.alias("epoch"), message.alias("message"))


def latest_log_time(status: DataFrame) -> DataFrame:
    """Entry time, or the file's time where no entry has a believable one."""
    earliest = F.lit(EARLIEST_VALID_TIME).cast("timestamp")
    entry = F.when(F.col("last_entry") >= earliest, F.col("last_entry"))
    return status.withColumn("latest", F.coalesce(entry, F.col("file_mtime")))


def suspend_seconds(status: DataFrame, as_of: Column | dt.datetime | str) -> DataFrame:
    """Whole seconds of silence: -10 without a believable time, 0 without entries."""
    now = moment(as_of)
    earliest = F.lit(EARLIEST_VALID_TIME).cast("timestamp")
    believable = F.coalesce(F.col("latest") >= earliest, F.lit(False))
    micros = F.unix_micros(now) - F.unix_micros("latest")
    seconds = F.expr("_micros div 1000000").cast("int")
    return (status.withColumn("_micros", micros)
            .withColumn("suspend_seconds", F.when(F.col("entries") == 0, F.lit(0))
                        .when(believable, seconds).otherwise(F.lit(NO_TIME_SECONDS)))
            .withColumn("tail_time", now).drop("_micros"))


def oversized_ranks(lines: DataFrame, limit: int = MAX_LINE_BYTES) -> DataFrame:
    """Ranks with a line too long to read; such a rank fails as a whole."""
    widest = lines.groupBy("node", "rank_no", "rank").agg(F.max(F.octet_length("line")).alias("line_bytes"))
    return widest.filter(F.col("line_bytes") >= limit)


def expected_ranks(ranges: DataFrame, inclusive: bool = True) -> DataFrame:
    """One row per rank a node should have; the top rank only if ``inclusive``."""
    top = F.col("max_rank") if inclusive else F.col("max_rank") - 1
    return (ranges.filter(F.col("min_rank") <= top)
            .select("node", F.explode(F.sequence(F.col("min_rank"), top)).alias("rank_no"))
            .withColumn("rank", rank_label("rank_no")))


def complete_ranks(ranges: DataFrame, status: DataFrame, files: DataFrame | None = None,
                   failed: DataFrame | None = None, inclusive: bool = True,
                   reason: str = "no such file") -> DataFrame:
    """Every expected rank, with a marker entry where its log could not be read.

    ``status`` has been through ``suspend_seconds``.  ``files`` lists the log
    files that exist, so an empty file is told from a missing one: it gives no
    entries and 0 seconds.  ``failed`` adds ``node, rank_no, reason`` of files
    that exist but could not be read.
    """
    log = ["log"] if "log" in status.columns else []
    expected = expected_ranks(ranges, inclusive)
    known = status.select(*RANK_KEYS, "entries", "latest", "suspend_seconds", *log, F.lit(True).alias("_seen"))
    out = expected.join(known, RANK_KEYS, "left")
    if files is not None:
        out = out.join(files.select(*RANK_KEYS, F.lit(True).alias("_file")).distinct(), RANK_KEYS, "left")
    else:
        out = out.withColumn("_file", F.col("_seen"))
    if failed is not None:
        out = out.join(failed.select(*RANK_KEYS, F.col("reason").alias("_why")), RANK_KEYS, "left")
    else:
        out = out.withColumn("_why", F.lit(None).cast("string"))
    unreadable = F.when(F.col("_file").isNull(), F.lit(reason)).otherwise(F.col("_why"))
    out = out.withColumn("marker", F.concat(F.lit("Log reading failed: "), unreadable))
    broken = F.col("marker").isNotNull()
    one = F.array(_log_item(F.lit(""), F.lit(0), F.lit(0), F.col("marker")))
    logs = [F.when(broken, one).otherwise(F.coalesce("log", F.slice(one, 1, 0))).alias("log")] if log else []
    return out.select(
        "node", "rank_no", "rank",
        F.when(broken, F.lit(1)).otherwise(F.coalesce("entries", F.lit(0))).cast("bigint").alias("entries"),
        F.when(~broken, F.col("latest")).alias("latest"),
        F.when(broken, F.lit(NO_TIME_SECONDS)).otherwise(F.coalesce("suspend_seconds", F.lit(0))).alias("suspend_seconds"),
        "marker", *logs,
    )


def suspicious_ranks(status: DataFrame, threshold: int = DEFAULT_HANG_SECONDS) -> DataFrame:
    return status.filter(F.col("suspend_seconds") > threshold)


def suspicious_nodes(status: DataFrame, threshold: int = DEFAULT_HANG_SECONDS) -> DataFrame:
    """Nodes with a silent rank, and the first such rank in rank order."""
    first = F.min_by(F.struct("rank", "suspend_seconds"), "rank_no").alias("_first")
    return (suspicious_ranks(status, threshold).groupBy("node").agg(first)
            .select("node", F.col("_first.rank").alias("rank"), F.col("_first.suspend_seconds").alias("suspend_seconds")))


def merge_rank_logs(status: DataFrame) -> DataFrame:
    """One nested record per rank, from a status made ``with_log``."""
    return status.select("node", "rank_no", "rank", F.col("log").alias("entries"), "suspend_seconds")


def order_by_rank(df: DataFrame) -> DataFrame:
    return df.orderBy(extract_number("rank"), "rank")


def highest_rank(df: DataFrame) -> DataFrame:
    """The label with the largest number in it."""
    return df.agg(F.max_by("rank", extract_number("rank")).alias("rank"))


def latest_run_dir(listing: DataFrame) -> DataFrame:
    """Newest sub-directory per work directory; equal times go to the larger path."""
    return (listing.filter("is_dir").groupBy("work_dir")
            .agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime")))
