"""Operating system processes: launcher, trainers and data workers.

A process table has ``node, pid, ppid, name, cmdline, environ``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainscope.functions.stacks import process_type
from trainscope.functions.text import environ_value, rank_label, text_to_int
from trainscope.operators.skew import spread_join
from trainscope.operators.snapshots import pair_keys


def launchers(procs: DataFrame, pattern: str) -> DataFrame:
    return procs.filter(F.col("cmdline").rlike(pattern)).select("node", F.col("pid").alias("ppid"))


def process_tree(procs: DataFrame) -> DataFrame:
    """Trainers under a launcher, and data workers under a trainer with its rank.

    All trainers of a node share one parent, so that join is spread; a worker
    joins its own trainer, where adaptive skew handling is enough.
    """
    ranked = procs.withColumn("rank", environ_value("environ", "RANK")).filter("rank <> ''")
    trainers = (spread_join(ranked, launchers(procs, "torchrun"), ["node", "ppid"], ["pid"])
                .select("node", "pid", "ppid", text_to_int(F.col("rank")).alias("rank"),
                        text_to_int(environ_value("environ", "LOCAL_RANK")).alias("local_rank")))
    parents = trainers.select("node", F.col("pid").alias("ppid"), "rank", "local_rank")
    workers = (procs.filter(F.col("name") == "pt_data_worker").select("node", "pid", "ppid")
               .join(parents, ["node", "ppid"]))
    both = (trainers.withColumn("type", F.lit("trainer"))
            .unionByName(workers.withColumn("type", F.lit("dataloader"))))
    return both.select("node", "type", "pid", "ppid", "rank", "local_rank")


def rank_range(procs: DataFrame) -> DataFrame:
    """Lowest and highest rank under the first launcher of each node."""
    first = launchers(procs, "torchrun|distributed.launch").groupBy("node").agg(F.min("ppid").alias("ppid"))
    rank = environ_value("environ", "RANK")
    ranked = procs.withColumn("rank_no", F.when(rank.rlike(r"\A[0-9]+\z"), text_to_int(rank)))
    children = spread_join(ranked.filter("rank_no is not null").select("node", "pid", "ppid", "rank_no"),
                           first, ["node", "ppid"], ["pid"])
    return children.groupBy("node").agg(F.min("rank_no").alias("min_rank"), F.max("rank_no").alias("max_rank"))


def labelled(tree: DataFrame) -> DataFrame:
    """The tree with type numbers and rank labels, as stored in snapshots."""
    return tree.select("node", "pid", "ppid", process_type("type").alias("type"),
                       rank_label("rank").alias("rank"), rank_label("local_rank").alias("local_rank"))


def filter_processes(df: DataFrame, type: int | None = None, rank: str | int | None = None) -> DataFrame:
    """By type number and rank; the label's case does not matter, a bare number works too."""
    if type:
        df = df.filter(F.col("type") == type)
    if rank is not None and rank != "":
        label = f"RANK{rank}" if str(rank).isdigit() else str(rank)
        df = df.filter(F.lower("rank") == label.lower())
    return df


def process_counts(snaps: DataFrame) -> DataFrame:
    return snaps.groupBy(*pair_keys(snaps)).agg(F.count("*").alias("total_processes"))
