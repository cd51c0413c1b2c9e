"""Writers.  All append, and all leave rows in the tasks that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.operators.processes import process_counts
from trainscope.operators.skew import spread_join
from trainscope.operators.snapshots import pair_keys
from trainscope.session import setting, stored

EVENTS_PER_FILE = 100_000
#: A packed file is read by one task from its beginning, so this bounds what a task reads.
PROCESSES_PER_FILE = 50_000
#: Files that a task has open at once; records of further nodes and verdicts are sorted.
OPEN_FILES = 16


def event_day(timestamp_ms: Column | str) -> Column:
    days = F.floor((F.col(timestamp_ms) if isinstance(timestamp_ms, str) else timestamp_ms) / 86_400_000)
    return F.date_add(F.to_date(F.lit("1970-01-01")), days.cast("int"))


def append_events(events: DataFrame, path: str, rows_per_file: int = EVENTS_PER_FILE) -> None:
    """Add events to a Parquet store by day.

    Rows are dealt out by time, so a day is written by the few tasks whose range it falls into and each file has
    narrow bounds; a day with most of the events is written by many.
    """
    stored = events.withColumn("event_date", event_day("timestamp"))
    (stored.repartitionByRange("event_date", "timestamp").sortWithinPartitions("event_date", "timestamp").write.mode("append")
     .partitionBy("event_date").option("maxRecordsPerFile", rows_per_file).parquet(path))


def rank_log_records(merged: DataFrame) -> DataFrame:
    """Records as written: zero level and epoch are left out, the message key is capital."""
    entry = F.transform("entries", lambda e: F.struct(
        e["timestamp"].alias("timestamp"), F.nullif(e["level"], F.lit(0)).alias("level"),
        F.nullif(e["epoch"], F.lit(0)).alias("epoch"), e["message"].alias("Message")))
    return merged.select("rank", entry.alias("entries"), "suspend_seconds", "tail_time")


def write_rank_logs(merged: DataFrame, path: str, job: str, rank: str | None = None) -> None:
    records = rank_log_records(merged if rank is None else merged.filter(F.col("rank") == rank))
    (records.withColumn("job", F.lit(job)).withColumn("selection", F.lit(rank or "allrank"))
     .write.mode("append").partitionBy("job", "selection").json(path))


def write_process_snapshots(snaps: DataFrame, verdicts: DataFrame, path: str, samples: DataFrame | None = None,
                            compression: str = "gzip", rows_per_file: int = PROCESSES_PER_FILE) -> None:
    """Snapshots by node and verdict, one process per record, with its sample's count.

    Records are set apart by blank lines and name their node and sample, so ``read_snapshots`` gives back the
    same tables.  With ``samples``, those without processes are written as records without a pid.  Every record
    repeats its sample's names and, in a hung job, stacks of its neighbours, so the files are packed, in a form that
    ``read_snapshots`` and Spark's readers know; ``compression="none"`` leaves them plain.
    """
    keys = pair_keys(snaps)
    verdicts = stored(verdicts.select(*keys, "verdict"), "verdicts-of-samples")
    counts = process_counts(snaps).withColumnRenamed("total_processes", "total_count")
    # Both sides have one row per node and sample; the count joins there first.  Stored, since Spark
    # would shuffle all processes before it knows how few these rows are.
    facts = stored(counts.join(verdicts, keys, "left").withColumn("verdict", F.coalesce("verdict", F.lit("first"))), "facts-of-samples")
    rows = spread_join(snaps, facts, keys, ["pid"])
    if samples is not None:
        bare = samples.join(facts.select(*keys), keys, "left_anti").join(verdicts, keys, "left")
        rows = rows.unionByName(bare.select(*keys, "snapshot_time", F.coalesce("verdict", F.lit("first")).alias("verdict"),
                                            F.lit(0).cast("bigint").alias("total_count")), allowMissingColumns=True)
    if "check_id" not in keys:
        rows = rows.withColumn("check_id", F.lit(""))
    # A task meets few nodes: with a file open for each, its records need not be sorted, which held or spilled them all.
    with setting(rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        (rows.withColumn("node_name", F.col("node")).write.mode("append").partitionBy("node", "verdict").option("lineSep", "\n\n")
         .option("compression", compression).option("maxRecordsPerFile", rows_per_file).json(path))


def write_alert_messages(messages: DataFrame, path: str) -> None:
    """The payloads as lines of text, one message each; sending them is the caller's."""
    messages.select(F.col("payload").alias("value")).write.mode("append").text(path)
