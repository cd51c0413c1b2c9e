"""Exact top-k search by histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainscope.llm.common import small_batches, stored, table

#: Queries that are searched at a time; their vectors go to every task.
QUERIES = 2048
#: Bins into which each refinement splits a range.
BINS = 4096
#: Rows that are scored at a time in a task.
ROWS = 2048


def _vectors(table_: DataFrame, scale: float) -> DataFrame:
    """``(vec_id, q)``: components as floor(scale * x); rows with nulls or components that are not finite are left out."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    return table_.where(valid).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("q"))


class Block:
    """Queries of one length of vector, with the range of (score, id) that holds each one's k-th row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        self.low, self.high = np.full(n, -(1 << 62)), np.full(n, 1 << 62)  # the k-th key lies in low..high
        self.need = np.zeros(n, np.int64)  # its place among the rows of that range, from the top

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Inner products, exact: in floating point only where every sum stays below 2^53."""
        bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, vectors.shape[1])
        if bound < 2**53:
            return (self.vectors.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
        return self.vectors @ vectors.T


def _lots(batches, dim: int):
    """Arrays of ids and vectors of the given length from batches ``(vec_id, q)``."""
    for batch in batches:
        ids, q = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("q")
        lengths = np.diff(q.offsets.to_numpy())
        flat = q.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        fit = np.flatnonzero(lengths == dim)
        for i in range(0, len(fit), ROWS):
            at = fit[i:i + ROWS]
            yield ids[at], flat[starts[at][:, None] + np.arange(dim)].reshape(len(at), dim)


def _histograms(rows: DataFrame, block: Block, k: int, by_id: np.ndarray, score: np.ndarray | None) -> dict[int, dict[int, int]]:
    """For each query the rows per bin of its range, complete down to its k-th row.

    A task sends only bins at or above its own k-th best, at most k for each query: the k-th best of all
    rows is never below the k-th best of some.
    """
    dim = block.vectors.shape[1]
    width = np.maximum(1, -(-(block.high - block.low + 1) // BINS))

    def count(batches):
        total: list[dict[int, int]] = [{} for _ in block.ids]
        floor = np.full(len(block.ids), -1)
        for ids, vectors in _lots(batches, dim):
            s = block.scores(vectors)
            key = np.where(by_id[:, None], -ids[None, :], s)
            use = (key >= block.low[:, None]) & (key <= block.high[:, None]) & (ids[None, :] != block.ids[:, None])
            if score is not None:
                use &= ~by_id[:, None] | (s == score[:, None])
            bins = np.where(use, (key - block.low[:, None]) // width[:, None], -1)
            use &= bins >= floor[:, None]
            at, place = np.nonzero(use)
            found, times = np.unique(at * BINS + bins[at, place], return_counts=True)
            touched = set()
            for x, n in zip(found.tolist(), times.tolist()):
                i, b = divmod(x, BINS)
                total[i][b] = total[i].get(b, 0) + n
                touched.add(i)
            for i in touched:
                above = 0
                for b in sorted(total[i], reverse=True):
                    if above >= k:
                        del total[i][b]
                    else:
                        above += total[i][b]
                        floor[i] = b if above >= k else floor[i]
        out = [(i, b, n) for i, own in enumerate(total) for b, n in own.items()]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("i", "bin", "n"))})

    sums = rows.mapInArrow(count, "i long, bin long, n long").groupBy("i", "bin").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("i").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    best = sums.withColumn("above", F.coalesce(F.sum("n").over(top), F.lit(0))).where(F.col("above") < k)
    got: dict[int, dict[int, int]] = {}
    for r in best.collect():  # at most k bins for each query of the block
        got.setdefault(r["i"], {})[r["bin"]] = int(r["n"])
    return got


def _narrow(rows: DataFrame, block: Block, k: int, by_id: np.ndarray, score: np.ndarray | None, open_: np.ndarray) -> None:
    """Refine each open query's range until it is the single key of the k-th row."""
    while (open_ & (block.high > block.low)).any():
        width = np.maximum(1, -(-(block.high - block.low + 1) // BINS))
        got = _histograms(rows, block, k, by_id, score)
        for i in np.flatnonzero(open_ & (block.high > block.low)):
            left = block.need[i]
            for b in sorted(got.get(i, {}), reverse=True):
                if left <= got[i][b]:
                    block.high[i] = min(block.high[i], block.low[i] + (b + 1) * width[i] - 1)
                    block.low[i] += b * width[i]
                    block.need[i] = left
                    break
                left -= got[i][b]
            else:
                open_[i] = False  # fewer than k rows: all of them count
                block.low[i] = block.high[i] = -(1 << 62)


def _block_result(rows: DataFrame, block: Block, k: int) -> DataFrame:
    n, dim = len(block.ids), block.vectors.shape[1]
    largest = rows.where(F.size("q") == dim).agg(
        F.max(F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0] or 0.0
    bound = (np.sqrt((block.vectors.astype(np.float64) ** 2).sum(1)) * largest * (1 + 1e-9)).astype(np.int64) + 1
    block.low, block.high, block.need = -bound, bound, np.full(n, k, np.int64)
    open_ = np.ones(n, bool)
    _narrow(rows, block, k, np.zeros(n, bool), None, open_)
    score = block.low.copy()  # of the k-th row; all rows above it count, and of its ties ``need``
    block.low, block.high = np.full(n, -(1 << 62)), np.full(n, 1 << 62)
    ids = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
    block.low, block.high = np.full(n, -ids[1]), np.full(n, -ids[0])
    tied = open_.copy()
    if tied.any():
        _narrow(rows, block, k, np.ones(n, bool), score, tied)
    last = np.where(open_, -block.low, np.iinfo(np.int64).max)  # the last id that counts among the ties

    def pick(batches):
        for ids, vectors in _lots(batches, dim):
            s = block.scores(vectors)
            use = (s > score[:, None]) | ((s == score[:, None]) & (ids[None, :] <= last[:, None]))
            at, place = np.nonzero(use & (ids[None, :] != block.ids[:, None]))
            yield pa.RecordBatch.from_pydict({"query_id": block.ids[at], "vec_id": ids[place], "score": s[at, place]})

    found = rows.mapInArrow(pick, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows of ``vectors(vec_id, embedding)`` for each query row.

    Components count as floor(scale * x) and the score is the integer inner product.  A query's own id is
    no candidate; ties go to the smaller ``vec_id``.  Vectors that are null, or hold null or not finite
    components, and rows without id take no part; vectors of another length than the query's are not
    compared with it.  Fewer than k rows give all of them; an empty table gives none.  A row that is
    repeated is as many candidates.  A query id that stands in several rows is one query, by its
    smallest vector.

    Queries go to the tasks in blocks of ``QUERIES``; vectors are not shuffled.  For each block all rows
    are scored into histograms that are refined around each query's k-th score, then in the same way by
    id among the rows that tie with it.  So the last pass sends no more than k rows for each query,
    however many rows tie.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(_vectors(vectors, scale), "topk-vectors")
    asked = (rows.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q")).withColumn("dim", F.size("q")))
    asked = stored(asked, "topk-queries")
    result = None
    for dim, count in sorted((r["dim"], r["count"]) for r in asked.groupBy("dim").count().collect()):
        parts = -(-count // QUERIES)
        for part in range(parts):
            own = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)).orderBy("vec_id").collect()
            if own:
                block = Block(np.array([r["vec_id"] for r in own], np.int64), np.array([r["q"] for r in own], np.int64).reshape(len(own), dim))
                found = _block_result(rows, block, k)
                result = found if result is None else result.unionByName(found)
    if result is None:
        schema = "query_id long, rank int, vec_id long, score long"
        result = spark.createDataFrame([], T.StructType.fromDDL(schema))
    return result


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    """The ten best rows of ``embeddings`` for each row whose id is divisible by 100."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
