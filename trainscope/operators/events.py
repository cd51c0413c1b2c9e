"""Stored events and alerts.

An event table has the columns of ``schemas.EVENT_SCHEMA``, and ``node`` and
``path`` where an operator says so.  Times are milliseconds since 1970, UTC.
A ledger has ``id, processed, processed_at, seq`` and only ever grows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.functions.events import alert_payload, severity_name
from trainscope.operators.skew import number_by_ranges, spread_join
from trainscope.schemas import DEFAULT_EVENT_TYPE

DAY_MS = 86_400_000

# --- Fixed values: notification texts -------------------------------------------
NO_ALERT_TIME = "0001-01-01 00:00:00.000"
ALERT_LINE = "%d. Time: %s\n   Level: %s\n   Message: %s\n"
MESSAGE_HEAD = "【{prefix}】\nNode: %s\nProcessing time: %s\n--------------------\n"
STATUS_FAILED = "Status: Failed\nError message: %s\n"
STATUS_FOUND = "Status: Found %d alerts\n"


@dataclass(frozen=True)
class EventFilter:
    """Optional conditions on events; ``None`` and ``""`` mean no condition."""

    start_ms: int | None = None
    end_ms: int | None = None
    min_severity: int = 0
    type: str | None = None
    source: str | None = None
    job_id: str | None = None
    unprocessed: bool = False

    def condition(self) -> Column:
        """One conjunction over plain columns, so it reaches the file scan."""
        terms = [F.col("severity") >= self.min_severity]
        if self.start_ms is not None:
            terms.append(F.col("timestamp") >= self.start_ms)
        if self.end_ms is not None:
            terms.append(F.col("timestamp") <= self.end_ms)
        terms += [F.col(name) == value for name, value in
                  (("type", self.type), ("source", self.source), ("job_id", self.job_id)) if value]
        if self.unprocessed:
            terms.append(~F.col("processed"))
        return _all(terms)


def _all(terms: list[Column]) -> Column:
    whole = terms[0]
    for term in terms[1:]:
        whole = whole & term
    return whole


def filter_events(events: DataFrame, by: EventFilter) -> DataFrame:
    """Matching events; both time ends count.  Day partitions are pruned where present."""
    if "event_date" in events.columns:
        day = lambda ms: F.to_date(F.lit("1970-01-01")) + F.lit(ms // DAY_MS).cast("int")
        if by.start_ms is not None:
            events = events.filter(F.col("event_date") >= day(by.start_ms))
        if by.end_ms is not None:
            events = events.filter(F.col("event_date") <= day(by.end_ms))
    return events.filter(by.condition())


def poll_window(last_end_ms: int | None, now_ms: int, min_severity: int = 0) -> EventFilter:
    """The next poll of unprocessed alerts.  The first one starts in 2000.

    Neighbouring windows share their edge; the ledger keeps it from counting twice.
    """
    start = 946_684_800_000 if last_end_ms is None else last_end_ms
    return EventFilter(start, now_ms, min_severity, DEFAULT_EVENT_TYPE, unprocessed=True)


def event_defaults(events: DataFrame, now_ms: int | Column, new_id: Column | None = None) -> DataFrame:
    """Fill a missing id, time and type.  Pass ``new_id`` where a rerun must agree."""
    fresh = F.expr("uuid()") if new_id is None else new_id
    now = F.lit(now_ms).cast("bigint")
    when = F.when(F.coalesce("timestamp", F.lit(0)) == 0, now).otherwise(F.col("timestamp"))
    return (events.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), fresh))
            .withColumn("timestamp", when)
            .withColumn("type", F.coalesce(F.nullif("type", F.lit("")), F.lit(DEFAULT_EVENT_TYPE))))


def alert_projection(events: DataFrame, *keep: str) -> DataFrame:
    return events.select(*keep, "message", F.timestamp_millis("timestamp").alias("timestamp"), "severity")


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), "id")


# --- processed marks ----------------------------------------------------------

def latest_marks(ledger: DataFrame) -> DataFrame:
    """Last mark of each event.  Doubled ledger rows change nothing."""
    mark = F.struct("processed", "processed_at")
    return (ledger.groupBy("id").agg(F.max_by(mark, F.struct("seq", "processed_at", "processed")).alias("_m"))
            .select("id", F.col("_m.processed").alias("_processed"), F.col("_m.processed_at").alias("_processed_at")))


def apply_processed(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events with their last mark; events without one stay as stored."""
    return (events.join(latest_marks(ledger), "id", "left")
            .withColumn("processed", F.coalesce("_processed", "processed"))
            .withColumn("processed_at", F.coalesce("_processed_at", "processed_at"))
            .drop("_processed", "_processed_at"))


def unprocessed(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose last mark, or stored state without one, says unprocessed."""
    return apply_processed(events, ledger).filter("not processed")


def marks_for(returned: DataFrame, now_ms: int | Column, seq: int | Column) -> DataFrame:
    """Ledger rows for returned events: all of them, whether asked for as unprocessed or not."""
    return returned.select("id", F.lit(True).alias("processed"), F.lit(now_ms).cast("bigint").alias("processed_at"),
                           F.lit(seq).cast("bigint").alias("seq"))


# --- file index -----------------------------------------------------------------

def event_file_index(events: DataFrame) -> DataFrame:
    """Bounds per event file.  Types are grouped first, so a set holds each type once."""
    by_type = events.groupBy("path", "type").agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        F.max("severity").alias("severity"), F.every("processed").alias("processed"))
    return by_type.groupBy("path").agg(
        F.min("lo").alias("min_time"), F.max("hi").alias("max_time"),
        F.greatest(F.max("severity"), F.lit(0)).alias("max_severity"),
        F.array_sort(F.collect_set("type")).alias("event_types"),
        F.every("processed").alias("all_processed"))


def candidate_files(index: DataFrame, by: EventFilter) -> DataFrame:
    """Files that may hold a match; source and job do not prune."""
    terms = [F.col("max_severity") >= by.min_severity]
    if by.start_ms is not None:
        terms.append(F.col("max_time") >= by.start_ms)
    if by.end_ms is not None:
        terms.append(F.col("min_time") <= by.end_ms)
    if by.type:
        terms.append(F.array_contains("event_types", by.type))
    if by.unprocessed:
        terms.append(~F.col("all_processed"))
    return index.filter(_all(terms)).select("path")


def prune_event_files(events: DataFrame, index: DataFrame, by: EventFilter) -> DataFrame:
    return spread_join(events, candidate_files(index, by), ["path"], ["id"], "left_semi")


# --- per node reports ------------------------------------------------------------

def number_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with ``alert_no`` per node, newest first, equal times by id; alerts without a node are not numbered.

    A node may hold a large share of all alerts, and of those one millisecond may: numbers come from ranges.
    """
    order = [F.coalesce("timestamp", F.lit(0).cast("bigint")).desc(), F.asc("id")]
    return number_by_ranges(alerts.filter("node is not null"), ["node"], order, "alert_no")


def alert_rollup(nodes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alert count per asked node.  ``no_alert`` only for an answer without alerts.

    The alerts themselves stay in long form (``number_alerts``): a node's list
    has no bound that would fit one row.
    """
    counts = alerts.groupBy("node").agg(F.count("*").alias("_n"))
    return (nodes.join(counts, "node", "left")
            .select("node", F.when(F.col("error").isNull(), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0))
                    .cast("bigint").alias("alert_count"), "error")
            .withColumn("no_alert", F.col("error").isNull() & (F.col("alert_count") == 0)))


def alert_messages(nodes: DataFrame, alerts: DataFrame, processing_time: str,
                   prefix: str = "Alert Notification:", per_message: int = 500) -> DataFrame:
    """Notification texts and payloads, numbered in parts of ``per_message`` alerts.

    A node with no more alerts than that gets the one usual message; with more,
    the list runs on in further messages, so a payload stays of bounded size and
    every alert is told.  Nodes without alerts get none; failed nodes get theirs.
    """
    rollup = alert_rollup(nodes, alerts).filter(~F.col("no_alert"))
    shown = F.coalesce(F.date_format(
        F.to_utc_timestamp(F.timestamp_millis("timestamp"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSS"),
        F.lit(NO_ALERT_TIME))
    line = F.format_string(ALERT_LINE,
                           "alert_no", shown, severity_name("severity"), F.coalesce("message", F.lit("")))
    part = F.expr(f"(alert_no - 1) div {int(per_message)}")
    numbered = number_alerts(alerts).select("node", "alert_no", part.alias("part"), line.alias("line"))
    bodies = numbered.groupBy("node", "part").agg(
        F.array_sort(F.collect_list(F.struct("alert_no", "line"))).alias("_lines"))
    body = F.array_join(F.transform("_lines", lambda x: x["line"]), "")
    parts = rollup.join(bodies.select("node", "part", body.alias("_body")), "node", "left")
    head = F.format_string(MESSAGE_HEAD.format(prefix=prefix.replace("%", "%%")),
                           "node", F.lit(processing_time))
    status = (F.when(F.col("error").isNotNull(), F.format_string(STATUS_FAILED, "error"))
              .otherwise(F.concat(F.format_string(STATUS_FOUND, "alert_count"), F.col("_body"))))
    text = F.concat(head, status)
    # A failed node has one message, whatever alerts are stored for it.
    return (parts.filter("error is null or part is null or part = 0")
            .select("node", F.coalesce("part", F.lit(0).cast("bigint")).alias("part"), text.alias("text"))
            .withColumn("payload", alert_payload("text")))
