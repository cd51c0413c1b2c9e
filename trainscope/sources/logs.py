"""Rank log files and run directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscope.functions.text import rank_label, trim_space
from trainscope.schemas import RANK_FILE


def read_rank_logs(spark: SparkSession, run_dir: str | list[str], node: Column | str | None = None,
                   rank: int | None = None) -> DataFrame:
    """Lines of every ``rank<N>.log`` below ``run_dir``; the rank is in the file name.

    ``line_no`` is the place of a line in its file: the start of the block it was
    read from and its order there, so one large file may be read by many tasks.
    ``node`` is a name, or an expression over the ``path`` column.  ``rank``
    limits the files listed, not only the rows kept.
    """
    glob = f"rank{rank}.log" if rank is not None else "rank*.log"
    raw = (spark.read.option("lineSep", "\n").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").text(run_dir))
    number = F.regexp_extract("path", RANK_FILE, 1)
    return (raw.select(
                F.regexp_replace("value", r"\r\z", "").alias("line"),
                F.col("_metadata.file_path").alias("path"),
                F.struct(F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("row")).alias("line_no"),
                F.col("_metadata.file_modification_time").alias("file_mtime"))
            .withColumn("rank_no", F.when(number != "", number).try_cast("int")).filter("rank_no is not null")
            .withColumn("rank", rank_label("rank_no"))
            .withColumn("node", F.lit(node) if isinstance(node, str) or node is None else node))


def list_rank_files(spark: SparkSession, run_dir: str | list[str], node: Column | str | None = None) -> DataFrame:
    """The log files themselves, empty ones too.

    A scan skips empty files, so the names come from Spark's file index, which
    the driver holds for any read of the folder.
    """
    names = (spark.read.option("pathGlobFilter", "rank*.log").option("recursiveFileLookup", "true")
             .text(run_dir).inputFiles())
    files = spark.createDataFrame([(name,) for name in names], "path string")
    number = F.regexp_extract("path", RANK_FILE, 1)
    return (files.withColumn("rank_no", F.when(number != "", number).try_cast("int")).filter("rank_no is not null")
            .withColumn("rank", rank_label("rank_no"))
            .withColumn("node", F.lit(node) if isinstance(node, str) or node is None else node))


def list_run_dirs(spark: SparkSession, work_dir: str) -> DataFrame:
    """Run directories below ``work_dir`` for ``latest_run_dir``.

    Spark lists files, not directories, so the time of a run is that of its
    newest log file.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.log")
             .option("recursiveFileLookup", "true").load(work_dir))
    path = F.regexp_replace("path", r"/[^/]*\z", "")
    return (files.groupBy(path.alias("path")).agg(F.max("modificationTime").alias("mtime"))
            .select(F.lit(work_dir).alias("work_dir"), "path", "mtime", F.lit(True).alias("is_dir")))


def read_node_list(spark: SparkSession, path: str) -> DataFrame:
    """One address per line.  A list without any is an error."""
    nodes = spark.read.text(path).select(trim_space("value").alias("node")).filter("node <> ''")
    if nodes.isEmpty():
        raise ValueError("node list file is empty or malformed")
    return nodes
