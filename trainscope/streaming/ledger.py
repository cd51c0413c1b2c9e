"""Processed marks as sorted runs that are merged, and alert delivery against them.

A ledger folder holds ``marks/stream_id=<s>/batch_id=<n>``, one folder for each batch of a stream; ``runs/run=<id>/bucket=<b>``,
marks of many batches with one row an id; and ``manifest/version=<v>``, the runs that count and up to which batch
each stream's marks are in them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trainscope.operators.events import EventFilter, filter_events, latest_marks, marks_for
from trainscope.schemas import DEFAULT_EVENT_TYPE, LEDGER_SCHEMA
from trainscope.session import stored

#: Parts of a run by a hash of the id: a batch reads only the parts that its ids fall into.
BUCKETS = 64
#: Batches whose marks are left loose before they are merged.
LOOSE = 16

_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_SCHEMA)
_MARKS = f"{_COLUMNS}, stream_id string, batch_id bigint"
_RUN = f"{_COLUMNS}, bucket int"
_MANIFEST = "path string, rows bigint, stream_id string, up_to bigint"


def _bucket(id_: Column | str) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def _folder(spark: SparkSession, path: str):
    """The folder in the Hadoop file system that Spark reads it with, and its path there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    system, where = _folder(spark, path)
    return system.exists(where)


class Manifest:
    """The newest version of the manifest: a handful of runs, and one number for each stream."""

    def __init__(self, spark: SparkSession, ledger: str):
        self.version, self.runs, self.up_to = -1, [], {}
        if _exists(spark, f"{ledger}/manifest"):
            system, where = _folder(spark, f"{ledger}/manifest")
            done = [f.getPath() for f in system.listStatus(where) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
            versions = [int(p.getName().removeprefix("version=")) for p in done if p.getName().startswith("version=")]
            if versions:
                self.version = max(versions)
                for r in spark.read.schema(_MANIFEST).parquet(f"{ledger}/manifest/version={self.version}").collect():
                    if r["path"] is not None:
                        self.runs.append((r["path"], r["rows"]))
                    else:
                        self.up_to[r["stream_id"]] = r["up_to"]


def _loose(spark: SparkSession, ledger: str, manifest: Manifest) -> DataFrame:
    """Marks of batches that no run holds yet, by partitions alone."""
    if not _exists(spark, f"{ledger}/marks"):
        return spark.createDataFrame([], _MARKS)
    marks = spark.read.schema(_MARKS).parquet(f"{ledger}/marks")
    for stream, up_to in manifest.up_to.items():
        marks = marks.filter((F.col("stream_id") != stream) | (F.col("batch_id") > up_to))
    return marks


def _held(spark: SparkSession, ledger: str, manifest: Manifest) -> list[DataFrame]:
    return [spark.read.schema(_RUN).parquet(f"{ledger}/{path}") for path, _ in manifest.runs]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All marks, as ``latest_marks`` and ``apply_processed`` take them."""
    manifest = Manifest(spark, ledger)
    columns = LEDGER_SCHEMA.fieldNames()
    out = _loose(spark, ledger, manifest).select(columns)
    for run in _held(spark, ledger, manifest):
        out = out.unionByName(run.select(columns))
    return out


def merge_marks(spark: SparkSession, ledger: str, before: dict[str, int] | None = None, loose: int = LOOSE) -> bool:
    """Merge loose marks into a run once there are ``loose`` batches of them; whether it did.

    Runs no more than twice as large as what is merged are merged too, so a ledger of n marks has about log n
    runs and a mark is written about log n times.  ``before`` names batches of streams that still run: theirs
    from that number on stay loose.  Readers see the old manifest until the new one is complete; one
    process at a time may merge a ledger.
    """
    manifest = Manifest(spark, ledger)
    marks = _loose(spark, ledger, manifest)
    for stream, batch in (before or {}).items():
        marks = marks.filter((F.col("stream_id") != stream) | (F.col("batch_id") < batch))
    batches = marks.groupBy("stream_id", "batch_id").count().collect()
    if len(batches) < loose:
        return False
    size, kept, taken = sum(r["count"] for r in batches), list(manifest.runs), []
    while kept and kept[-1][1] <= 2 * size:
        taken.append(kept.pop())
        size += taken[-1][1]
    rows = marks.select(LEDGER_SCHEMA.fieldNames())
    for path, _ in taken:
        rows = rows.unionByName(spark.read.schema(_RUN).parquet(f"{ledger}/{path}").select(LEDGER_SCHEMA.fieldNames()))
    last = F.max_by(F.struct("processed", "processed_at", "seq"), F.struct("seq", "processed_at", "processed"))
    merged = rows.groupBy("id").agg(last.alias("m")).select("id", "m.processed", "m.processed_at", "m.seq", _bucket("id").alias("bucket"))
    path = f"runs/run={uuid.uuid4().hex}"
    merged.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{ledger}/{path}")
    count = spark.read.schema(_RUN).parquet(f"{ledger}/{path}").count()
    up_to = dict(manifest.up_to)
    for r in batches:
        up_to[r["stream_id"]] = max(up_to.get(r["stream_id"], -1), r["batch_id"])
    entries = [(p, n, None, None) for p, n in [*kept, (path, count)]] + [(None, None, s, b) for s, b in up_to.items()]
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/manifest/version={manifest.version + 1}")
    return True


def drop_merged(spark: SparkSession, ledger: str) -> int:
    """Delete runs, marks and manifests that the newest manifest no longer needs; how many folders went.

    Call it when no reader of an older manifest is left.
    """
    manifest = Manifest(spark, ledger)
    if manifest.version < 0:
        return 0
    live, old = {p.split("/")[-1] for p, _ in manifest.runs}, []

    def below(path: str) -> list[str]:
        system, where = _folder(spark, path)
        return [f.getPath().getName() for f in system.listStatus(where) if f.isDirectory()] if system.exists(where) else []

    old += [f"{ledger}/runs/{r}" for r in below(f"{ledger}/runs") if r not in live]
    old += [f"{ledger}/manifest/{v}" for v in below(f"{ledger}/manifest") if v != f"version={manifest.version}"]
    for stream, up_to in manifest.up_to.items():
        folder = f"{ledger}/marks/stream_id={stream}"
        old += [f"{folder}/{b}" for b in below(folder) if int(b.removeprefix("batch_id=")) <= up_to]
    for path in old:
        system, where = _folder(spark, path)
        system.delete(where, True)
    return len(old)


def _told(spark: SparkSession, ledger: str, ids: DataFrame, stream_id: str, batch_id: int) -> DataFrame:
    """Ids of the batch whose last mark says processed; marks that this batch itself left behind do not count."""
    manifest = Manifest(spark, ledger)
    parts = [r[0] for r in ids.select(_bucket("id")).distinct().collect()]  # at most ``BUCKETS`` numbers
    columns = LEDGER_SCHEMA.fieldNames()
    own = (F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)
    marks = _loose(spark, ledger, manifest).filter(~own).select(columns)
    for run in _held(spark, ledger, manifest):
        marks = marks.unionByName(run.filter(F.col("bucket").isin(parts)).select(columns))
    return latest_marks(marks.join(ids.select("id"), "id", "left_semi")).filter("_processed").select("id")


def deliver_alerts(events: DataFrame, ledger: str, checkpoint: str, stream_id: str, now_ms: int | Column,
                   deliver: Callable[[DataFrame, int], None], min_severity: int = 0, loose: int = LOOSE) -> DataStreamWriter:
    """Deliver each alert that the ledger does not have, and mark it there; the caller sets the trigger and starts it.

    An alert is told once however late it comes, over restarts and over streams that share the ledger one after
    another, and the stream holds no state of its own.  ``deliver(alerts, batch_id)`` gets the same alerts
    when a batch is run again after a failure, and should replace what it wrote for that batch.  Of
    rows with one id in a batch the earliest is told; rows without id are not alerts.
    A new checkpoint counts its batches from 0 again and needs a ``stream_id`` of its own.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merge_marks(spark, ledger, {stream_id: batch_id}, loose)
        by = EventFilter(min_severity=min_severity, type=DEFAULT_EVENT_TYPE, unprocessed=True)
        wanted = filter_events(batch, by).filter("id is not null")
        first = F.min(F.struct("timestamp", *(c for c in ("severity", "node", "message") if c in batch.columns))).alias("one")
        wanted = stored(wanted.groupBy("id").agg(first).select("id", "one.*"), "alerts-of-batch")
        new = stored(wanted.join(_told(spark, ledger, wanted, stream_id, batch_id), "id", "left_anti"), "new-alerts")
        deliver(new, batch_id)
        marks_for(new, now_ms, batch_id).write.mode("overwrite").parquet(f"{ledger}/marks/stream_id={stream_id}/batch_id={batch_id}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
