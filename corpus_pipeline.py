"""From raw documents to shards of training text: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscope.llm.common import table
from trainscope.llm.decontamination import without_contamination
from trainscope.llm.jaccard_join import jaccard_survivors, row_key
from trainscope.llm.mixing import mix_sources
from trainscope.llm.sharding import shard_documents
from trainscope.llm.toxicity import learn_toxicity, score_toxicity
from trainscope.session import work_path

WEIGHTS, SHARE, SHARDS = [3, 1, 2], 1.5, 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from the labels does not reject; null and empty texts stay."""
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 80 per cent: that of the smallest id, nulls last.

    Each row is judged by its own text, whatever id it has.  Of rows of one id the one whose text hashes
    lowest stays, and of those with the same text too the least by the other columns.  Texts without words
    are no copies of each other, so all of them stay.
    """
    blank = F.coalesce("text", F.lit("")).rlike(r"\A[ \t-\r]*\z")
    # Rows alike in id and text become one before the join, so a frequent id or text fills no task.
    order = F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), "doc_id", "text")
    single = docs.where(~blank).groupBy(row_key().alias("uid")).agg(F.min(order).alias("row"))
    kept = single.join(jaccard_survivors(docs, k=5, num=80, den=100), "uid", "left_semi").select("row.*")
    return kept.select(docs.columns).unionByName(docs.where(blank))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that copies a benchmark item."""
    return without_contamination(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    mixed = mix_sources(docs, WEIGHTS, SHARE)
    times = F.explode(F.expr("sequence(1, copies)"))
    return mixed.where("copies > 0").withColumn("__copy", times).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return shard_documents(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated),
          ("mixing", mix), ("sharding", shard)]

#: Learned terms and weights cannot be said in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
