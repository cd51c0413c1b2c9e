"""Hard negatives of anchors, found with bounds that run along a spanning tree of the anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainscope.llm.common import small_batches, stored, table
from trainscope.session import work_path

#: Anchors of one tree.
ANCHORS = 512
#: Bytes of anchor vectors that go to the tasks at a time; more anchors go in further passes.
PASS_BYTES = 16 << 20
#: Above this share of open pairs a level of the tree is scored whole, by one matrix product.
DENSE = 0.1

_NONE = np.iinfo(np.int64).min
_TREE = "dim int, ids binary, labels binary, vectors binary, parents binary, edges binary"
_FOUND = "anchor_id long, slot int, vec_id long, score long"


def _vectors(rows: DataFrame, scale: float) -> DataFrame:
    """``(vec_id, label, q)``: components as floor(scale * x); rows that take no part are left out."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.where(valid).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                    whole.cast("array<long>").alias("q"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of runs of rows whose vectors are of one length."""
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        q = batch.column("q")
        lengths, flat = np.diff(q.offsets.to_numpy()), q.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            yield ids[at], labels[at], flat[starts[at][:, None] + np.arange(dim)].reshape(len(at), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, exact: in floating point only where every sum stays below 2^53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each vector in a minimum spanning tree, -1 for the first, and the length of the edge to it."""
    n, real = len(vectors), vectors.astype(np.float64)
    parent, edge = np.full(n, -1, np.int32), np.zeros(n)
    nearest, through, out = np.full(n, np.inf), np.zeros(n, np.int32), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        out[at] = False
        distance = np.sqrt(((real - real[at]) ** 2).sum(1))
        closer = out & (distance < nearest)
        nearest[closer], through[closer] = distance[closer], at
        at = int(np.argmin(np.where(out, nearest, np.inf)))
        parent[at], edge[at] = through[at], nearest[at]
    return parent, edge


def _trees(anchors: DataFrame, count: int) -> DataFrame:
    """One row for each tree of at most ``ANCHORS`` anchors of one length that lie near each other.

    Anchors are sorted by the signs of a few fixed projections over all tasks, and each task cuts its
    stretch into trees as it goes, so it holds one tree at a time.
    """
    def sketch(batches):
        for batch in batches:
            for ids, labels, q in _matrices([batch]):
                planes = np.random.default_rng(q.shape[1]).standard_normal((q.shape[1], 12))
                code = ((q.astype(np.float64) @ planes) > 0) @ (1 << np.arange(12))
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array(np.full(len(ids), q.shape[1]), pa.int32()), "code": pa.array(code, pa.int32()), "vec_id": pa.array(ids, pa.int64()),
                    "label": pa.array(labels, pa.int64()), "q": pa.array(list(q), pa.list_(pa.int64()))})

    def tree(parts):
        ids, labels, q = (np.concatenate(x) for x in zip(*parts))
        parents, edges = _spanning_tree(q)
        return pa.RecordBatch.from_pydict({"dim": pa.array([q.shape[1]], pa.int32())} | {
            c: pa.array([x.tobytes()], pa.binary()) for c, x in (("ids", ids), ("labels", labels), ("vectors", q), ("parents", parents), ("edges", edges))})

    def cut(batches):
        held, n = [], 0
        for ids, labels, q in _matrices(batches):
            if held and held[0][2].shape[1] != q.shape[1]:
                yield tree(held)
                held, n = [], 0
            while len(ids):
                take = ANCHORS - n
                held.append((ids[:take], labels[:take], q[:take]))
                n += len(held[-1][0])
                ids, labels, q = ids[take:], labels[take:], q[take:]
                if n == ANCHORS:
                    yield tree(held)
                    held, n = [], 0
        if held:
            yield tree(held)

    order = ["dim", "code", "vec_id"]
    known = anchors.mapInArrow(sketch, "dim int, code int, vec_id long, label long, q array<long>")
    parts = -(-count // (8 * ANCHORS))
    return known.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "label", "q").mapInArrow(cut, _TREE)


class Tree:
    """Anchors by their level in a spanning tree, and for each the scores that are wanted: ``low..high`` of every slot."""

    def __init__(self, row):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(self.ids), row["dim"])
        self.parents, self.edges = np.frombuffer(row["parents"], np.int32), np.frombuffer(row["edges"])
        depth = np.zeros(len(self.ids), np.int32)
        while (new := np.where(self.parents >= 0, depth[self.parents] + 1, 0)).tolist() != depth.tolist():
            depth = new
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]

    def scores(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray,
               same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(anchor, row, score)`` for every pair whose score lies in the anchor's ``low..high``.

        Only rows of the anchor's label count, or only others, and never the anchor's own id.  The root
        scores all rows.  From there on the score at a child lies within the parent's bounds, plus or minus
        edge length times the row's norm; a pair whose bounds meet the window is scored and has its score
        for bounds, any other passes its wider bounds on.
        """
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        least, most = np.empty((2, len(self.ids), len(ids)))
        wanted = low <= high
        for depth, level in enumerate(self.levels):
            open_ = np.ones((len(level), len(ids)), bool)
            if depth:
                reach = self.edges[level][:, None] * (1 + 1e-9) * norms + 1
                least[level], most[level] = least[self.parents[level]] - reach, most[self.parents[level]] + reach
                fit = (self.labels[level][:, None] == labels) if same else (self.labels[level][:, None] != labels)
                open_ = fit & wanted[level][:, None] & (most[level] >= low[level][:, None]) & (least[level] <= high[level][:, None])
            if open_.mean() > DENSE:
                s = _products(self.vectors[level], vectors)
                least[level] = most[level] = s
                at, row = np.nonzero((s >= low[level][:, None]) & (s <= high[level][:, None]))
                s = s[at, row]
            else:
                at, row = np.nonzero(open_)
                s = np.zeros(len(at), np.int64)
                for i in range(0, len(at), 1 << 16):
                    s[i:i + (1 << 16)] = (self.vectors[level[at[i:i + (1 << 16)]]] * vectors[row[i:i + (1 << 16)]]).sum(1)
                least[level[at], row] = most[level[at], row] = s
            at = level[at]
            use = (s >= low[at]) & (s <= high[at]) & ((self.labels[at] == labels[row]) == same) & (self.ids[at] != ids[row])
            yield at[use], row[use], s[use]


class _Best:
    """The best rows of each slot so far, by score, then smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.id, self.score = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(slots, _NONE)  # the k-th score of a slot: lower ones cannot count any more

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        slot, ids, score = np.concatenate([self.slot, slot]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.k - 1
        self.floor[slot[last]] = score[last]
        self.slot, self.id, self.score = slot[place < self.k], ids[place < self.k], score[place < self.k]


def _search(rows: DataFrame, trees: list[Tree], windows: list[tuple[np.ndarray, np.ndarray]], k: int, same: bool) -> DataFrame:
    """``(anchor_id, slot, vec_id, score)``: the k best rows in each window of each anchor, of all tasks.

    ``windows`` has for each tree the lowest and the highest score, by anchor and slot.  A task keeps k rows for
    each window and raises its lower end to the k-th of them, so later rows meet a narrower window.
    """
    sent = rows.sparkSession.sparkContext.broadcast((trees, windows))

    def find(batches):
        trees, windows = sent.value
        best = [_Best(low.size, k) for low, _ in windows]
        for ids, labels, q in _matrices(batches):
            for tree, (low, high), own in zip(trees, windows, best):
                if tree.vectors.shape[1] != q.shape[1]:
                    continue
                now = np.where(low <= high, np.maximum(low, own.floor.reshape(low.shape)), low)
                use = now <= high
                bottom, top = np.where(use, now, -_NONE - 1).min(1), np.where(use, high, _NONE).max(1)
                for at, row, s in tree.scores(ids, labels, q, bottom, top, same):
                    for slot in range(low.shape[1]):
                        hit = (s >= now[at, slot]) & (s <= high[at, slot])
                        if hit.any():
                            own.add(at[hit] * low.shape[1] + slot, ids[row[hit]], s[hit])
        for tree, (low, _), own in zip(trees, windows, best):
            at, slot = np.divmod(own.slot, low.shape[1])
            yield pa.RecordBatch.from_pydict({"anchor_id": pa.array(tree.ids[at], pa.int64()), "slot": pa.array(slot, pa.int32()),
                                              "vec_id": pa.array(own.id, pa.int64()), "score": pa.array(own.score, pa.int64())})

    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(find, _FOUND).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k)


def _passes(trees: DataFrame) -> Iterator[list[Tree]]:
    """The trees in lots of about ``PASS_BYTES``, so that the driver holds one lot at a time."""
    lot, size = [], 0
    for row in trees.toLocalIterator():
        lot.append(Tree(row))
        size += lot[-1].vectors.nbytes
        if size >= PASS_BYTES:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``vectors(vec_id, embedding, label)``.

    Components count as floor(scale * x) and a score is the integer inner product with the anchor.  An
    anchor's positives are its best other rows of the same label; the negatives of a positive the best rows
    of other labels whose score is ``low`` to ``high`` per cent of the positive's.  So a positive below zero
    has none.  Ties go to the smaller ``vec_id``.

    Rows without id, label or vector, or with a component that is null or not finite, take no part;
    vectors of another length than the anchor's are not compared with it.  A repeated row is as many
    candidates, except for rows of the anchor's own id.  An anchor id in several rows is one anchor, by its
    smallest label, then vector.  Fewer rows than asked for give all of them; an empty table gives none.

    Anchors are dealt into spanning trees and go to the tasks in passes of ``PASS_BYTES``.  Candidates are not
    shuffled: each task sends, for each anchor and window, its best rows alone.  Each pass is written, so
    a later failure does not repeat it.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(_vectors(vectors, scale), "negatives-vectors")
    anchors = stored(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("one"))
                     .select("vec_id", "one.label", "one.q"), "negatives-anchors")
    form = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    count, path = anchors.count(), work_path(spark, "negatives")
    if not count:
        return spark.createDataFrame([], T.StructType.fromDDL(form))
    for trees in _passes(stored(_trees(anchors, count), "negatives-trees")):
        everything = [(np.full((len(t.ids), 1), _NONE), np.full((len(t.ids), 1), -_NONE - 1)) for t in trees]
        near = stored(_search(rows, trees, everything, positives, True).select(
            "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
            "negatives-positives")
        found = near.select("anchor_id", "slot", "positive_score").toArrow()  # at most ``positives`` for each anchor of the pass
        anchor, slot, score = (c.to_numpy() for c in found.columns)
        windows = []
        for t in trees:
            bounds = np.zeros((2, len(t.ids), positives), np.int64)
            bounds[0] = 1  # nothing lies in 1..0
            order = np.argsort(t.ids)
            place = order[np.minimum(np.searchsorted(t.ids, anchor, sorter=order), len(order) - 1)]
            own = t.ids[place] == anchor
            bounds[0, place[own], slot[own]] = -(-low * score[own] // 100)
            bounds[1, place[own], slot[own]] = high * score[own] // 100
            windows.append((bounds[0], bounds[1]))
        hard = _search(rows, trees, windows, negatives, False)
        (hard.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                                                     "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path))
    return spark.read.schema(form).parquet(path)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row of ``embeddings``, after the labels of every 7th row are moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id, r) AS slot FROM s WHERE same) WHERE slot <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.slot ORDER BY s.score DESC, s.vec_id, s.r) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
