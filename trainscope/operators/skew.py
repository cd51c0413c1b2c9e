"""Ways to keep one hot key from landing in one task.

None of these drops or caps rows; each spreads a hot key over many tasks and
then combines small partial results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainscope.session import stored

SALTS = 32


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          salts: int = SALTS) -> DataFrame:
    """First ``n`` rows of each key, ``order`` being total within a key.

    The top n of a key is the top n of the top n of any split of it.  The split
    is by input partition: each task keeps n rows of a key before the shuffle,
    ``salts`` tasks reduce those, and one task sees at most ``salts * n`` rows.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
            .withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= n)
            .drop("_salt", "_rn"))


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join of a large side, hot on ``on``, with a side of few rows per key.

    The small side is repeated once per salt, so a hot key of the large side
    meets it in ``salts`` tasks; ``spread_by`` names large-side columns that
    differ within a key.  There is no broadcast hint: Spark broadcasts the small
    side itself when it measures it below its threshold.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def number_by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` per key without ever sorting a whole key in one task.

    All rows are sorted into ranges of about equal size by key and ``order``, so a hot key, or a hot value in
    it, runs through many of them.  Counts per key and range give the first number of each range, and only the
    rows of one range are numbered together.  The ranges are stored, so a lost task finds the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *(F.col(k) for k in keys), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (ranged.withColumn("_row", F.row_number().over(within)).join(starts, [*keys, "_range"])
            .withColumn(name, F.col("_start") + F.col("_row")).drop("_start", "_row", "_range"))
