"""Facts about the fleet: nodes, versions, failures and requests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainscope.functions.text import extract_nodes
from trainscope.schemas import LATENCY_BUCKETS


def union_results(*results: DataFrame) -> DataFrame:
    """Results of several nodes under one another; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def job_nodes(jobs: DataFrame, column: str = "description") -> DataFrame:
    """One row per node of each job description that has a node list."""
    return jobs.withColumn("node", F.explode(extract_nodes(column)))


def distinct_nodes(df: DataFrame) -> DataFrame:
    return df.select("node").distinct()


def version_counts(agents: DataFrame) -> DataFrame:
    """Nodes per version, answering nodes only."""
    return agents.filter("error is null").groupBy("version").agg(F.count("*").alias("nodes"))


def version_report(agents: DataFrame) -> DataFrame:
    """One row: the versions seen, whether they differ, whether there are none.

    Distinct versions are taken first, so the list grows with the builds in use
    and not with the nodes.
    """
    return version_counts(agents).agg(
        F.array_sort(F.collect_list("version")).alias("versions"),
        (F.count("*") > 1).alias("mismatch"),
        (F.count("*") == 0).alias("none"))


def failure_summary(results: DataFrame) -> DataFrame:
    """Failed and answering nodes per operation."""
    return results.groupBy("op").agg(F.count("error").alias("failed"),
                                     F.count_if(F.col("error").isNull()).alias("succeeded"))


def failure_messages(results: DataFrame) -> DataFrame:
    """One message row per failed node."""
    return (results.filter("error is not null")
            .select("op", "node", F.format_string("Node %s: %s", "node", "error").alias("message")))


def _status():
    return F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("error"))


def request_totals(rpc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests per method and status, and per further columns such as the instance."""
    return rpc.groupBy("method", _status().alias("status"), *by).agg(F.count("*").alias("requests"))


def latency_histogram(rpc: DataFrame, buckets: Sequence[str] = LATENCY_BUCKETS,
                      by: Sequence[str] = ()) -> DataFrame:
    """Cumulative bucket counts per method, with sum and count.

    One pass: a row adds to a conditional count per bucket.  The sum is taken in
    decimals, so it does not depend on the order of the rows.
    """
    duration = F.col("duration")
    counts = rpc.groupBy("method", *by).agg(
        *[F.count_if(duration <= F.lit(float(le))).alias(f"_b{i}") for i, le in enumerate(buckets)],
        F.sum(duration.cast("decimal(28,9)")).alias("duration_sum"),
        F.count("*").alias("duration_count"))
    rows = [F.struct(F.lit(le).alias("le"), F.col(f"_b{i}").alias("requests")) for i, le in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("duration_count").alias("requests")))
    return (counts.withColumn("_row", F.explode(F.array(*rows)))
            .select("method", *by, "_row.le", "_row.requests", "duration_sum", "duration_count"))
