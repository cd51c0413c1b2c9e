"""Event files and posted payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainscope.functions.events import payload_text
from trainscope.schemas import DEFAULT_EVENT_TYPE, EVENT_SCHEMA, WEBHOOK_SOURCE

_FILE_SCHEMA = T.StructType([
    T.StructField("events", T.ArrayType(EVENT_SCHEMA)),
    T.StructField("_corrupt_record", T.StringType()),
])


def _event_documents(spark: SparkSession, base: str, node_rank: int | str | None) -> DataFrame:
    """One row per file of the form ``{"events": [...]}``; their size is bounded by rotation."""
    mark = "" if node_rank is None else node_rank
    glob = f"*rank{mark}_events_*.json" if node_rank is not None else "*rank*_events_*.json"
    return (spark.read.schema(_FILE_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", glob)
            .json(base).withColumn("path", F.col("_metadata.file_path")))


def read_event_files(spark: SparkSession, base: str, node_rank: int | str | None = None) -> DataFrame:
    """Events of all readable files.  A broken file is left out, the others still load."""
    good = _event_documents(spark, base, node_rank).filter("_corrupt_record is null")
    rows = good.select("path", F.explode("events").alias("e")).select("path", "e.*")
    zero = {"id": "", "source": "", "type": "", "job_id": "", "message": ""}
    return (rows.fillna(zero).fillna(0, ["timestamp", "severity", "processed_at"])
            .fillna(False, ["processed"]))


def rejected_event_files(spark: SparkSession, base: str, node_rank: int | str | None = None) -> DataFrame:
    """Files that ``read_event_files`` leaves out, also half-readable ones, with the number of events parsed."""
    # Spark reads no file for its bad text alone, so the filter names the events too.
    bad = _event_documents(spark, base, node_rank).filter("_corrupt_record is not null and coalesce(size(events), -1) >= -1")
    return bad.select("path", F.col("_corrupt_record").alias("content"), F.greatest(F.size("events"), F.lit(0)).alias("parsed"))


def read_event_store(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet store written by ``append_events``."""
    return spark.read.parquet(path).withColumn("path", F.col("_metadata.file_path"))


def parse_event_payloads(df: DataFrame, column: str) -> DataFrame:
    """Adds the event fields of a posted message, and ``rejected`` for a bad one.

    Id and time are left empty for ``event_defaults``.
    """
    text = payload_text(column)
    return (df.withColumn("message", text).withColumn("rejected", F.col("message").isNull())
            .withColumn("source", F.lit(WEBHOOK_SOURCE)).withColumn("type", F.lit(DEFAULT_EVENT_TYPE))
            .withColumn("severity", F.lit(0)))


def payload_columns(parsed: DataFrame) -> DataFrame:
    """Parsed payloads with ``id`` and ``timestamp`` in the columns of an event."""
    return parsed.select(
        "id", "source", "type", F.lit("").alias("job_id"), "message", F.col("timestamp").cast("bigint").alias("timestamp"), "severity",
        F.lit(None).cast("variant").alias("metadata"), F.lit(False).alias("processed"), F.lit(0).cast("bigint").alias("processed_at"))


def payload_events(df: DataFrame, column: str, now_ms: int | Column, new_id: Column) -> DataFrame:
    """Complete event rows of the good payloads."""
    good = parse_event_payloads(df.withColumn("id", new_id), column).filter("not rejected")
    return payload_columns(good.withColumn("timestamp", F.lit(now_ms)))
