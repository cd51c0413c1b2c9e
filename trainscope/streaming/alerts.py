"""Alert delivery and event ingest over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trainscope.operators.events import EventFilter, filter_events, marks_for
from trainscope.schemas import DEFAULT_EVENT_TYPE
from trainscope.session import stored
from trainscope.sinks.tables import event_day
from trainscope.sources.events import parse_event_payloads, payload_columns, payload_events


def stream_alerts(events: DataFrame, min_severity: int = 0, lateness: str | None = None) -> DataFrame:
    """New alerts, each id once.

    The checkpoint of the query takes the place of the last poll's end and of the
    processed flag.  Alerts of any age are delivered and the state holds every id
    seen; with ``lateness`` it forgets ids that old, and alerts that come later
    than that are left out.
    """
    wanted = filter_events(events, EventFilter(min_severity=min_severity, type=DEFAULT_EVENT_TYPE, unprocessed=True))
    if lateness is None:
        return wanted.dropDuplicates(["id"])
    timed = wanted.withColumn("event_time", F.timestamp_millis("timestamp"))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["id"])


def payload_id(*source: Column | str) -> Column:
    """An id that is the same when a batch is read again: a hash of payload and position."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in source]
    return F.sha2(F.concat_ws("\x00", *text), 256)


def stream_event_ingest(raw: DataFrame, column: str, now_ms: int | Column, position: list[Column | str]) -> DataFrame:
    """Posted payloads as events; ``position`` identifies a message in its source."""
    return payload_events(raw, column, now_ms, payload_id(column, *position))


def write_event_stream(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that adds to the Parquet store by day; the caller sets the trigger and starts it."""
    return (events.withColumn("event_date", event_day("timestamp")).writeStream
            .option("checkpointLocation", checkpoint).option("path", path)
            .format("parquet").partitionBy("event_date").outputMode("append"))


def write_marks(returned: DataFrame, ledger_path: str, checkpoint: str, now_ms: int | Column,
                stream_id: str) -> DataStreamWriter:
    """Append a processed mark per delivered alert.

    Each batch of a stream owns one folder of the ledger and replaces it whole, so
    a batch that is run again after a failure leaves the same marks.  A new
    checkpoint counts its batches from 0 again and needs a ``stream_id`` of its own.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        marks_for(batch, now_ms, batch_id).write.mode("overwrite").parquet(f"{ledger_path}/stream_id={stream_id}/batch_id={batch_id}")

    return returned.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)


def write_ingest(raw: DataFrame, column: str, position: list[Column | str], arrival_ms: Column, store: str, rejects: str,
                 checkpoint: str) -> DataStreamWriter:
    """Posted payloads into the event store, and those that are bad into a table of rejects.

    Both come from one reading of a batch.  An event's time is its message's ``arrival_ms``, an expression over the
    source's columns.  Rejects keep the payload, its id and its time.  Each batch owns one folder of the store and one
    of the rejects, so a batch that is run again replaces what it wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_event_payloads(batch.withColumn("id", payload_id(column, *position)).withColumn("timestamp", arrival_ms.cast("bigint")), column)
        parsed = stored(parsed.select("id", "timestamp", "rejected", "message", "source", "type", "severity", F.col(column).alias("payload")), "payloads")
        good = payload_columns(parsed.filter("not rejected")).withColumn("event_date", event_day("timestamp"))
        good.write.mode("overwrite").partitionBy("event_date").parquet(f"{store}/batch_id={batch_id}")
        parsed.filter("rejected").select("id", "timestamp", "payload").write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")

    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
