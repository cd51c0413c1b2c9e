"""A stored index of the event store: bounds per file, by which scans leave files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trainscope.operators.events import EventFilter, candidate_files, event_file_index, filter_events

_INDEX = ("path string, min_time bigint, max_time bigint, max_severity int, event_types array<string>, all_processed boolean, "
          "rows bigint, event_date date")


def read_event_index(spark: SparkSession, path: str) -> DataFrame:
    """The index; without rows where none was written yet."""
    try:
        return spark.read.schema(_INDEX).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _INDEX)


def _files(spark: SparkSession, names: list[str], store: str) -> DataFrame:
    return spark.read.option("basePath", store).parquet(*names)


def update_event_index(spark: SparkSession, store: str, index: str) -> int:
    """Add the files that the index does not have; the number of them.

    Files of the store are never changed, so an entry holds for good and only new files are read.  An
    update that is run again after a failure may add an entry twice, which changes nothing.
    """
    listed = spark.read.parquet(store).inputFiles()  # what Spark's own listing of the store holds
    names = spark.createDataFrame([(name,) for name in listed], "path string")
    new = [r["path"] for r in names.join(read_event_index(spark, index).select("path"), "path", "left_anti").collect()]
    if not new:
        return 0
    # One form of a local name: Spark lists files as file:/// and reads them as file:/
    events = _files(spark, new, store).withColumn("path", F.regexp_replace("_metadata.file_path", r"\Afile:/+", "file:///"))
    counts = events.groupBy("path").agg(F.count("*").alias("rows"), F.min("event_date").alias("event_date"))
    event_file_index(events).join(counts, "path").write.mode("append").parquet(index)
    return len(new)


def read_matching_events(spark: SparkSession, store: str, index: str, by: EventFilter) -> DataFrame:
    """The events that ``filter_events`` finds in the store, from the files alone that may hold one.

    The index names those files and only they are scanned; inside them the filter reaches the row groups.
    The index is brought up to date first, so no new file is missed.
    """
    update_event_index(spark, store, index)
    names = [r["path"] for r in candidate_files(read_event_index(spark, index), by).distinct().collect()]
    if not names:
        return spark.read.parquet(store).filter(F.lit(False))
    return filter_events(_files(spark, names, store), by)
