"""Minimax contiguous partition of documents into shards, with Spark SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainscope.llm.common import stored, table

#: Segments of the order that the driver sees at a time, whatever the input.
SEGMENTS = 1 << 14
#: Rows that are numbered together.
ROWS = 500


@dataclass(frozen=True)
class Segment:
    """A run of the order: the groups whose key starts with the bits ``bucket``."""

    bucket: int
    shift: int
    size: int
    groups: int

    @property
    def end(self) -> int:
        return (self.bucket + 1) << self.shift


def _segments(groups: DataFrame, shift: int, inside: list[Segment] | None = None) -> list[Segment]:
    """Sizes of the parts of some segments, or of the whole order, one row per part that is not empty."""
    if inside is not None:
        spans: list[list[int]] = []
        for s in inside:  # neighbours become one span
            if spans and spans[-1][1] == s.bucket << s.shift:
                spans[-1][1] = s.end
            else:
                spans.append([s.bucket << s.shift, s.end])
        spark = groups.sparkSession
        wanted = spark.createDataFrame([(a, b - 1) for a, b in spans], "first long, last long")
        groups = groups.join(F.broadcast(wanted), F.col("h").between(F.col("first"), F.col("last")), "left_semi")
    rows = groups.groupBy(F.expr(f"shiftright(h, {shift})").alias("bucket")).agg(
        F.sum("size").alias("size"), F.count("*").alias("groups")).collect()
    return sorted((Segment(r["bucket"], shift, int(r["size"]), r["groups"]) for r in rows), key=lambda s: s.bucket)


def _cuts(segments: list[Segment], capacity: int, fluid: bool) -> list[int] | None:
    """Where greedy filling ends each shard, as sizes from the start.

    ``fluid`` lets a shard end inside a segment of several groups, so it never needs more shards than
    the groups themselves; otherwise a shard ends between segments only, so it never needs fewer.
    """
    cuts, start, at = [], 0, 0
    for s in segments:
        if s.size > capacity and (s.groups == 1 or not fluid):
            return None
        while at + s.size - start > capacity:
            start = start + capacity if fluid and s.groups > 1 else at
            cuts.append(start)
        at += s.size
    return [*cuts, at]


def _search(segments: list[Segment], shards: int, fluid: bool) -> int:
    """The least capacity that greedy filling finds feasible."""
    total = sum(s.size for s in segments)
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        cuts = _cuts(segments, middle, fluid)
        if cuts is not None and len(cuts) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _refined(groups: DataFrame, shards: int) -> tuple[list[Segment], int]:
    """Segments fine enough to know the least capacity, and that capacity.

    The least capacity lies between that of fluid segments and that of whole ones.  While those
    differ, the segments in which a cut may fall are split by further bits of the key.
    """
    shift = 64 - SEGMENTS.bit_length() + 1
    segments = _segments(groups, shift)
    while segments:
        low, high = _search(segments, shards, True), _search(segments, shards, False)
        if low == high:
            return segments, high
        far = _cuts(segments, high, True) or []
        near = _cuts(segments, low, False) or [0]
        near += [near[-1]] * (len(far) - len(near))
        ends = list(accumulate(s.size for s in segments))
        doubtful = []
        j = 0
        for s, end in zip(segments, ends):
            while j < len(far) and far[j] < end - s.size:
                j += 1
            if s.groups > 1 and s.shift and (j == len(far) or near[j] <= end):
                doubtful.append(s)
        if not doubtful:
            doubtful = [s for s in segments if s.groups > 1 and s.shift]
        if not doubtful:
            return segments, high
        bits = max(1, (SEGMENTS // len(doubtful)).bit_length() - 1)
        by_shift: dict[int, list[Segment]] = {}
        for s in doubtful:
            by_shift.setdefault(s.shift, []).append(s)
        gone = set(doubtful)
        parts = [p for shift, some in by_shift.items() for p in _segments(groups, max(0, shift - bits), some)]
        segments = sorted([s for s in segments if s not in gone] + parts, key=lambda s: s.end)
    return [], 0


def _even_cuts(segments: list[Segment], capacity: int, shards: int) -> list[int]:
    """Keys at which shards 1, 2, ... begin: as even as the capacity and the segments allow."""
    ends = [0, *accumulate(s.size for s in segments)]
    total = ends[-1]
    latest = [total]  # the first boundary from which the last j shards hold the rest
    for _ in range(shards - 1):
        latest.append(next(e for e in ends if e >= latest[-1] - capacity))
    cuts, at, i = [], 0, 0
    for left in range(shards - 1, 0, -1):
        goal = at + (total - at) / (left + 1)
        allowed = [j for j in range(i, len(ends)) if latest[left] <= ends[j] <= at + capacity]
        i = min(allowed, key=lambda j: abs(ends[j] - goal))
        at = ends[i]
        cuts.append(segments[i - 1].end if i else -(1 << 63))
    return cuts


def shard_documents(docs: DataFrame, shards: int, size: str = "octet_length(text) + 16") -> DataFrame:
    """All columns of ``docs``, and ``size``, ``text_crc32``, ``shard`` and ``slot``, by the law ``bytes``.

    Rows with equal texts (also null ones) are one atomic group and share a shard.  Groups stand in the
    order of a 64-bit hash of the text; a group above the mean of what is left takes a shard of its
    own, largest first, since no cut can divide it.  Over the others the smallest feasible capacity is
    found by binary search with a greedy check, on a histogram of the order that is refined where cuts
    may fall.  The driver sees at most about ``SEGMENTS`` sums at a time.  The cuts are then placed as
    evenly as that capacity allows.  ``slot`` counts from 0 without gaps in each shard.

    A null text has 16 bytes and no crc.  Empty input gives no rows.  Columns of ``docs`` that have one
    of the four names are replaced.
    """
    rows = docs.drop("size", "text_crc32", "shard", "slot")
    rows = rows.withColumns({"size": F.coalesce(F.expr(size), F.lit(16)).cast("long"),
                             "text_crc32": F.crc32(F.col("text").cast("binary")), "__h": F.xxhash64("text")})
    groups = stored(rows.groupBy(F.col("__h").alias("h")).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    total, count = groups.agg(F.sum("size"), F.sum("n")).first()
    total, count = int(total or 0), int(count or 0)
    alone: list[int] = []
    for r in groups.orderBy(F.desc("size"), "h").limit(shards - 1).collect():
        if r["size"] * (shards - len(alone)) <= total:
            break
        alone.append(r["h"])
        total -= r["size"]
    left = shards - len(alone)
    segments, capacity = _refined(groups.where(~F.col("h").isin(alone)) if alone else groups, left)
    cuts = _even_cuts(segments, capacity, left) if segments else []

    keys = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<long>")
    shard = F.lit(len(alone)) + F.size(F.filter(keys, lambda c: c <= F.col("__h")))
    for i, h in enumerate(alone):
        shard = F.when(F.col("__h") == h, i).otherwise(shard)
    buckets = max(1, -(-count // (shards * ROWS)))
    rows = rows.withColumns({"shard": shard.cast("int"), "__b": F.pmod(F.xxhash64("doc_id", "__h"), F.lit(buckets))})
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "__b").agg(F.count("*").alias("__n"))
               .select("shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    place = F.row_number().over(Window.partitionBy("shard", "__b").orderBy("__h", "doc_id"))
    numbered = rows.withColumn("__place", place).join(offsets, ["shard", "__b"])
    return numbered.withColumn("slot", F.col("__before") + F.col("__place") - 1).select(
        *(c for c in rows.columns if not c.startswith("__") and c != "shard"), "shard", "slot")


def contract_columns(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                          F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of sizes as near equal as groups of equal texts allow."""
    return contract_columns(shard_documents(table(spark, sf_dir, "documents"), 40))
