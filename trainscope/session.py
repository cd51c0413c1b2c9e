"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffles at run time and checks the size of a join
# side before broadcasting it, so no operator carries a broadcast hint.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Of doubled names in a posted JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Session windows merge inside each map task before the shuffle, so one
    # very talkative rank sends a few rows per task instead of all its lines.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def builder(app_name: str = "trainscope") -> SparkSession.Builder:
    session = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        session = session.config(key, value)
    return session


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  A local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="trainscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/trainscope/{spark.sparkContext.applicationId}"


#: The folder, below the application's, of what is stored for a time.
_PASSING: ContextVar[str] = ContextVar("passing", default="")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder for one run, under the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{_PASSING.get()}{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_work(spark: SparkSession) -> bool:
    """Delete what this application has stored; results that were not written elsewhere are gone then."""
    return _delete(spark, _own_dir(spark))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds for the plans that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ending_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Each plan that runs inside removes its shuffle files as it ends, where they would stay until the driver collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, and shuffle files before that.

    For steps whose result is written elsewhere before the end.  A table made inside cannot be read afterwards.
    """
    folder = f"{_PASSING.get()}passing-{uuid.uuid4().hex}/"
    outer = _PASSING.set(folder)
    try:
        with ending_shuffles(spark):
            yield
    finally:
        _PASSING.reset(outer)
        _delete(spark, f"{_own_dir(spark)}/{folder}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a small result that several later plans read, and read it back.

    Its producer then runs once, a lost executor costs no rerun of it, and Spark
    knows its true size when it chooses a join.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
