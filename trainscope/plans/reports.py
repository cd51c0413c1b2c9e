"""Saved log and stack reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.functions.stacks import parse_stack_dump
from trainscope.functions.text import format_rfc3339
from trainscope.operators import logs as L
from trainscope.operators import processes as P
from trainscope.schemas import DEFAULT_TAIL_LINES


def log_report(lines: DataFrame, as_of: Column | dt.datetime | str, rank: str | None = None,
               ranges: DataFrame | None = None, n: int = DEFAULT_TAIL_LINES) -> DataFrame:
    """Nested log records of each rank.  The rank filter comes first, before any line is parsed."""
    wanted = L.filter_rank_logs(lines, rank)
    parsed = L.clean_messages(L.parse_log_lines(L.tail_lines(wanted, n), keep_bad_time=True))
    status = L.suspend_seconds(L.latest_log_time(L.rank_status(parsed, with_log=True)), as_of)
    if ranges is not None:
        status = L.filter_rank_logs(L.complete_ranks(ranges, status), rank)
    return L.merge_rank_logs(status).withColumn("tail_time", format_rfc3339(L.moment(as_of)))


def stack_report(procs: DataFrame, dumps: DataFrame, type: int | None = None,
                 rank: str | int | None = None) -> DataFrame:
    """Wanted processes with their threads; only their dumps are parsed."""
    wanted = P.filter_processes(P.labelled(P.process_tree(procs)), type, rank)
    return (wanted.join(dumps.select("node", "pid", "dump"), ["node", "pid"])
            .withColumn("threads", parse_stack_dump(F.col("dump"))).drop("dump"))
