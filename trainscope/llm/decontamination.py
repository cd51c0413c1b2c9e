"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.llm.common import small_batches, table
from trainscope.llm.words import MARKS, grams, pieces, words_of

#: Words of a seed.
SEED = 3
#: Alignment: match, mismatch and gap.
MATCH, MISS, GAP = 2, -1, -1
#: Bytes of items that are compared with the documents at a time.
BLOCK = 4 << 20
#: Share of the best possible score at which a passage counts as a copy.
LEAST = 0.5

_HIT = "array<struct<item_id:long,score:int,similarity:double,first_word:int,last_word:int>>"
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.int32()), ("similarity", pa.float64()),
                                 ("first_word", pa.int32()), ("last_word", pa.int32())]))


class Items:
    """One block of benchmark items and its seeds, small enough to be sent to every task."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = words_of(pa.array(texts, pa.string()), MARKS)
        keep = [i for i in range(len(ids)) if words.first[i + 1] - words.first[i] >= SEED]
        self.ids = [ids[i] for i in keep]
        self.words = [words.hash[words.first[i]:words.first[i + 1]] for i in keep]
        found = [grams(w, SEED) for w in self.words]
        self.item = np.repeat(np.arange(len(found)), [len(g) for g in found]).astype(np.int64)
        self.place = np.concatenate([np.arange(len(g)) for g in found] or [[]]).astype(np.int64)
        self.seed = np.concatenate(found or [np.zeros(0, np.uint64)])
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]
        self.distinct, self.start = np.unique(self.seed, return_index=True)
        self.count = np.diff(np.append(self.start, len(self.seed)))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.distinct >> np.uint64(44)).astype(np.int64)] = True

    def found(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the seeds of some texts are seeds of items, and which."""
        at = np.flatnonzero(self.filter[(seeds >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.distinct, seeds[at]), len(self.distinct) - 1)
        same = self.distinct[which] == seeds[at]
        return at[same], which[same]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair, and the first and last word of it in the passage.

    All pairs advance together along the anti-diagonals of their tables.
    """
    n, m, w = len(items), max(map(len, items)), max(map(len, passages))
    item, passage = np.full((n, m), 1, np.uint64), np.full((n, w + 2), 2, np.uint64)
    for i, (a, b) in enumerate(zip(items, passages)):
        item[i, :len(a)], passage[i, 1:len(b) + 1] = a, b
    inside = np.arange(m) < np.array([len(a) for a in items])[:, None]
    limit = np.array([len(b) for b in passages])[:, None]
    best, first, last = (np.zeros(n, np.int32) for _ in range(3))
    before, now = (np.zeros((n, m + 1), np.int32) for _ in range(2))
    from_before, from_now = (np.zeros((n, m + 1), np.int32) for _ in range(2))
    row, every = np.arange(m), np.arange(n)
    for d in range(m + w - 1):
        j = d - row
        ok = (j >= 0) & (j < limit) & inside
        same = item == passage[:, np.clip(j, -1, w) + 1]
        diagonal = before[:, :-1] + np.where(same, MATCH, MISS)
        up, left = now[:, :-1] + GAP, now[:, 1:] + GAP
        score = np.maximum(np.maximum(diagonal, up), np.maximum(left, 0))
        begun = np.where(score == diagonal, np.where(before[:, :-1] > 0, from_before[:, :-1], j),
                         np.where(score == up, from_now[:, :-1], from_now[:, 1:]))
        score, begun = np.where(ok, score, 0), np.where(ok, begun, 0)
        top = np.argmax(score, axis=1)
        value = score[every, top]
        better = value > best
        best[better], first[better], last[better] = value[better], begun[every, top][better], (d - top)[better]
        before, from_before = now, from_now
        now, from_now = (np.concatenate([np.zeros((n, 1), np.int32), x.astype(np.int32)], axis=1) for x in (score, begun))
    return best, first, last


def _passages(texts: pa.Array, items: Items, least: float) -> list[list[dict]]:
    """For each text its passages that align with an item."""
    words = words_of(texts, MARKS)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    seeds = grams(words.hash, SEED)
    at, which = items.found(seeds)
    row = np.searchsorted(words.first, at, "right") - 1
    whole = at + SEED <= words.first[row + 1]
    at, which, row = at[whole], which[whole], row[whole]
    if not len(at):
        return out
    times = items.count[which]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    entry = np.repeat(items.start[which], times) + nth
    at, row = np.repeat(at, times), np.repeat(row, times)
    item = items.item[entry]
    begin = at - items.place[entry]  # where the item would begin, without gaps
    order = np.lexsort((begin, item, row))
    row, item, begin = row[order], item[order], begin[order]
    length = np.array([len(w) for w in items.words])[item]
    pad = np.maximum(4, length // 4)
    # Windows of an item that overlap are one, so no passage is found twice.
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > (length + 2 * pad)[1:])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    low = np.maximum(begin[head] - pad[head], words.first[row[head]])
    high = np.minimum(begin[tail] + length[head] + pad[head], words.first[row[head] + 1])
    row, item, length = row[head], item[head], length[head]
    while len(row):
        rest: list[tuple[int, int, int]] = []
        # Pairs of like length go together, in lots of bounded size.
        order = np.argsort(length + high - low, kind="stable")
        lot: list[int] = []
        for k, i in enumerate(order):
            lot.append(i)
            if k + 1 < len(order):
                j = order[k + 1]
                if len(lot) * int(length[j] + 1) < 1 << 16 and len(lot) * int(length[j] + high[j] - low[j]) < 1 << 20:
                    continue
            best, first, last = align([items.words[item[i]] for i in lot], [words.hash[low[i]:high[i]] for i in lot])
            for i, s, a, b in zip(lot, best.tolist(), first.tolist(), last.tolist()):
                share = s / (MATCH * int(length[i]))
                if s and share >= least:
                    offset = int(low[i] - words.first[row[i]])
                    out[row[i]].append({"item_id": items.ids[item[i]], "score": s, "similarity": share,
                                        "first_word": offset + a, "last_word": offset + b})
                    # What the window holds before and after may be another copy if it has words enough.
                    rest += [(i, x, y) for x, y in ((low[i], low[i] + a), (low[i] + b + 1, high[i])) if y - x >= max(SEED, least * length[i])]
            lot = []
        i, low, high = (np.array([r[n] for r in rest], np.int64) for n in range(3))
        row, item, length = row[i], item[i], length[i]
    return out


def _finder(items: Items, least: float) -> Column:
    @F.arrow_udf(_HIT)
    def find(texts: pa.Array) -> pa.Array:
        found = []
        for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
            found += _passages(piece.column(0), items, least)
        return pa.array(found, _HIT_ARROW)

    return find.asNondeterministic()(F.col("text").cast("string"))  # so that Spark runs it once a row


def _blocks(docs: DataFrame, benchmark: DataFrame):
    """The items in blocks of bounded size."""
    small_batches(docs.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    sums = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(sums) // BLOCK))
    for i in range(n):
        own = sorted(tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect())
        block = Items([r[0] for r in own], [r[1] for r in own])
        if len(block.distinct):
            yield block


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``(doc_id, item_id, score, similarity, first_word, last_word)``: passages of documents that copy an item.

    Words are runs without ASCII white space and punctuation, A-Z as lower case.  The seeds of an item
    are all its runs of three words.  Where a document holds a seed, the item is aligned with the passage
    around it, up to a quarter of the item longer on both sides, and the passage counts when its score is
    at least ``least`` of that of an exact copy.  Before and after that passage the same is done again, so
    copies that follow each other all count.  A copy without three words in a row of its item is not found.

    Items go to the tasks in blocks of ``BLOCK`` bytes; each block reads all documents once, and documents
    are never shuffled.  Null and empty texts have no passages; items without text, id or three words
    find nothing.  A document row that is repeated is reported as often.  No passages give no rows.
    """
    found = None
    for block in _blocks(docs, benchmark):
        hits = docs.select("doc_id", _finder(block, least).alias("hit"))
        hits = hits.select("doc_id", F.explode("hit").alias("hit")).select("doc_id", "hit.*")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.limit(0).select("doc_id", F.explode(F.array().cast(_HIT)).alias("hit")).select("doc_id", "hit.*")
    return found


def without_contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item; rows with null text stay."""
    for block in _blocks(docs, benchmark):
        docs = docs.where(F.size(_finder(block, least)) == 0)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Passages of all documents that copy a benchmark item."""
    return contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
