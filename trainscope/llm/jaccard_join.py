"""N-gram Jaccard join by T-occurrence search (DivideSkip), and its components."""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.llm.common import small_batches, stored, table
from trainscope.llm.graph import connected_components
from trainscope.llm.words import Words, grams, mix, pieces, runs, signed, words_of

#: Rows of two or three numbers that may be broadcast.
BROADCAST_ROWS = 1 << 20
#: Shingles in one block of documents that a task searches at a time, some 50 bytes each; larger groups are searched block against block.
BLOCK = 1 << 20
#: Entries that a heap merges; it takes about a microsecond for each.
HEAP = 64


# --- sets ------------------------------------------------------------------------------

def _sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text of a piece."""
    found = grams(words.hash, k)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            yield np.unique(found[a:b - k + 1])
        elif b > a:  # the whole sequence, told apart from a shingle by its length
            yield mix(grams(words.hash[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield words.hash[:0]


def _piece_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    return _sets(words_of(batch.column("text")), k)


def needed(size: int, num: int, den: int) -> int:
    """The least overlap of a set of this size with any set that it links with."""
    return -(-num * size // den)


# --- T-occurrence search ----------------------------------------------------------------

def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of sorted lists, and in how many lists each stands.

    A heap merges them one entry at a time; lists of more than ``HEAP`` entries together are merged as
    the runs of one array, which gives the same order.
    """
    if sum(map(len, lists)) <= HEAP:
        found = [(place, len(list(same))) for place, same in groupby(heapq.merge(*(one.tolist() for one in lists)))]
        return np.array([p for p, _ in found], np.int64), np.array([n for _, n in found], np.int64)
    return np.unique(np.sort(np.concatenate(lists), kind="stable"), return_counts=True)


class Lists:
    """Inverted lists over a block of sets: for each shingle the sorted places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        place = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.place = place[order]
        self.token, self.start = np.unique(every[order], return_index=True)
        self.stop = np.append(self.start[1:], len(every))
        # Each list's number, then the place: rises over all lists, so one probe may ask many of them.
        self.entry = np.repeat(np.arange(len(self.token)), self.stop - self.start) * max(1, len(sets)) + self.place

    def search(self, query: np.ndarray, num: int, den: int, own: int | None = None, sought: Callable[[int], bool] | None = None) -> list[int]:
        """Places of the sets with den * |both| >= num * |either|, of those that are sought.

        ``own`` is the query's place if its set is in the block; it is not returned then.
        """
        if not len(query) or not len(self.token):
            return []
        at = np.searchsorted(self.token, query)
        at = at[self.token[np.minimum(at, len(self.token) - 1)] == query]
        least = needed(len(query), num, den)
        least = needed(len(query) + least, num, num + den)  # overlap with the smallest set that may link
        if len(at) < least:
            return []
        length = self.stop[at] - self.start[at]
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        # DivideSkip: so many of the longest lists are probed, the others are merged.
        n_long = min(least - 1, int(least / (0.01 * np.log2(int(length[-1]) + 1) + 1)))
        cut = len(at) - n_long
        first = int(np.searchsorted(length[:cut], 2)) if own is not None else 0  # lists before hold the query's set alone
        if int(length[first:cut].sum()) - (cut - first if own is not None else 0) < least - n_long:
            return []
        places, overlap = _merged([self.place[self.start[t]:self.stop[t]] for t in at[first:cut]])
        size = self.sizes[places]
        near = (den * np.minimum(size, len(query)) >= num * np.maximum(size, len(query))) & (places != own if own is not None else True)
        near &= overlap + n_long >= -(-num * (len(query) + size) // (num + den))
        if sought is not None:
            near[near] = [sought(p) for p in places[near].tolist()]
        places, overlap, size = places[near], overlap[near], size[near]
        if not len(places):
            return []
        asked = at[cut:, None] * len(self.sizes) + places[None, :]
        probe = np.searchsorted(self.entry, asked)
        overlap = overlap + (self.entry[np.minimum(probe, len(self.entry) - 1)] == asked).sum(0)
        return places[den * overlap >= num * (len(query) + size - overlap)].tolist()


def _block_edges(ids: list[int], sets: list[np.ndarray], group: list[int], queries: list[int], centre: int | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect whatever the queries link with in this block, none of them needless.

    ``group`` gives what is connected already.  A query is left out once it is connected with the
    centre: whoever is not searches for itself, so a link between two components is found from one side.
    After the centre come the sets whose shingles are the most common, for they link with the most.
    """
    root = {g: g for g in group}

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    lists, edges = Lists(sets), []
    length = lists.stop - lists.start
    common = {q: length[np.searchsorted(lists.token, sets[q])].mean() for q in queries if q != centre and len(sets[q])}
    for q in [q for q in queries if q == centre] + sorted(common, key=lambda q: (-common[q], q)):
        if centre is not None and q != centre and top(group[q]) == top(group[centre]):
            continue
        mine = top(group[q])
        for p in lists.search(sets[q], num, den, q, lambda p: top(group[p]) != mine):
            a, b = top(group[q]), top(group[p])
            if a != b:
                root[a] = b
                edges.append((ids[q], ids[p]))
    return edges


# --- the join -----------------------------------------------------------------------------

class Signatures:
    """Signatures of which two sets that link share at least one.

    Sets of about one size are cut by hash into parts, more than any two that link differ in elements;
    so ``spare + 1`` parts at least are equal in both.  A set leaves out its ``spare`` smallest parts:
    the largest of the equal parts stays in both.  A part holds several shingles, so documents that only
    share a phrase or a passage seldom meet.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edge = [1]  # sizes at which a class begins
        while self.edge[-1] < 1 << 31:
            self.edge.append(max(self.edge[-1] + 1, self.edge[-1] * 7 // 5))

    def of(self, s: np.ndarray) -> np.ndarray:
        """For the set's own class and, where a larger set that links may be in another, for that one too."""
        n, out = len(s), []
        for size in range(bisect(self.edge, n) - 1, bisect(self.edge, n * self.den // self.num)):
            differ = 2 * (self.edge[size + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            if differ:  # otherwise only equal sets link
                spare = -(-(differ + 1) // 10)
                parts = np.uint64(differ + 1 + spare)
                part = ((s >> np.uint64(32)) * parts) >> np.uint64(32)  # rises with s, so parts are runs
                count = np.bincount(part.astype(np.int64), minlength=int(parts))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + np.uint64(size + 1)))])
                end = np.cumsum(count)
                content = total[end] - total[end - count]
                keep = np.lexsort((content, count))[spare:]
                out.append(mix(content[keep] + mix(keep.astype(np.uint64) * np.uint64(2**20) + np.uint64(size + 1))))
        return np.concatenate(out) if out else s[:0]


_DOC = "doc_id long, uid long, n int, v long"
#: Sets that a task remembers, so that copies in it are sent once; other copies are sent again and found equal later.
SEEN = 1 << 16


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=8).digest()


def _described(docs: DataFrame, k: int) -> DataFrame:
    """Size and digest of each document's set."""
    def describe(batches):
        for batch in batches:
            for piece in pieces(batch):
                size, digest = [], []
                for s in _piece_sets(piece, k):
                    size.append(len(s))
                    digest.append(_digest(s))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("uid"), pa.array(size, pa.int32()), pa.array(np.frombuffer(b"".join(digest), np.int64))],
                    ["doc_id", "uid", "n", "v"])

    return docs.mapInArrow(describe, _DOC)


def _distinct(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The digests and sets of each piece, without empty sets and those that this task has seen lately."""
    seen: set[int] = set()
    for batch in batches:
        for piece in pieces(batch):
            out = []
            for s in _piece_sets(piece, k):
                v = int.from_bytes(_digest(s), "little", signed=True)
                if len(s) and v not in seen:
                    seen.add(v)
                    out.append((v, s))
            yield out
            if len(seen) > SEEN:
                seen.clear()


def _meetings(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(c, v)`` once for each signature that v shares with others, c being the least set that has it.

    Signatures are sorted with their sets over all tasks, so all who share one lie next to each other: the first
    is c, and nothing is held but the row before.  They are neither stored nor joined with anything.
    """
    signatures = Signatures(num, den)

    def sign(batches):
        for found in _distinct(batches, k):
            own = [signatures.of(s) for _, s in found]
            yield pa.RecordBatch.from_pydict({
                "signature": pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *own]))),
                "v": pa.array(np.repeat(np.array([v for v, _ in found], np.int64), [len(x) for x in own]) if own else np.zeros(0, np.int64))})

    def meet(batches):
        signature, first, last, alone = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            s, v = batch.column("signature").to_numpy(), batch.column("v").to_numpy()
            again = np.zeros(len(s), bool)  # the same set once more
            again[1:] = (s[1:] == s[:-1]) & (v[1:] == v[:-1])
            again[0] = s[0] == signature and v[0] == last
            s, v = s[~again], v[~again]
            if not len(s):
                continue
            begins = np.ones(len(s), bool)
            begins[1:] = s[1:] != s[:-1]
            begins[0] = s[0] != signature
            start = np.maximum.accumulate(np.where(begins, np.arange(len(s)), -1))
            c = np.where(start >= 0, v[start], first if first is not None else 0)
            before = np.append(alone, begins[:-1])  # the row before stood first, and has not been told yet
            second = ~begins & before
            signature, first, last, alone = s[-1], c[-1], v[-1], bool(begins[-1])
            yield pa.RecordBatch.from_pydict({"c": pa.array(np.concatenate([c[~begins], c[second]])), "v": pa.array(np.concatenate([v[~begins], c[second]]))})

    keyed = docs.select("text").mapInArrow(sign, "signature long, v long").repartition("signature").sortWithinPartitions("signature", "v")
    return keyed.mapInArrow(meet, "c long, v long")


def _set_rows(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(v, shingles)`` of the wanted sets ``(v, uid)``, built where a document lies that has it.

    A set is built again where a repeated row of that document lies in another task.
    """
    def build(batches):
        for found in _distinct(batches, k):
            yield pa.RecordBatch.from_pydict({"v": pa.array([v for v, _ in found], pa.int64()), "shingles": pa.array([s.tobytes() for _, s in found], pa.binary())})

    return docs.select("uid", "text").join(_few(wanted.select("uid")), "uid").select("text").mapInArrow(build, "v long, shingles binary")


def _search(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges from sorted blocks ``(c, block, part, role, v, own, shingles)``; role 0 is the centre, 1 a member, 2 a query.

    Without queries every set is one, the centre first.  ``own`` names what is connected already.
    """
    def search(batches):
        for run in runs(batches, ["c", "block", "part"]):
            at = run.column("v").to_numpy()
            new = np.ones(len(at), bool)  # rows of a run are sorted by role and set, so copies of a set lie together
            new[1:] = (at[1:] != at[:-1]) | (np.diff(run.column("role").to_numpy()) != 0)
            run = run if new.all() else run.filter(pa.array(new))
            role, v, own = (run.column(c).to_pylist() for c in ("role", "v", "own"))
            sets = [np.frombuffer(x, np.uint64) for x in run.column("shingles").to_pylist()]
            asked = [i for i, r in enumerate(role) if r == 2] or list(range(len(role)))
            edges = _block_edges(v, sets, own, asked, 0 if role[0] == 0 else None, num, den)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()),
                                              "b": pa.array([b for _, b in edges], pa.int64())})

    keyed = rows.repartition("c", "block", "part").sortWithinPartitions("c", "block", "part", "role", "v")
    return keyed.select("c", "block", "part", "role", "v", "own", "shingles").mapInArrow(search, "a long, b long")


def _few(df: DataFrame) -> DataFrame:
    """A stored table, broadcast to a join if its counted rows stay below a fixed bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_key() -> Column:
    """The name of a row's id and text; rows that have both in common share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _linked(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """All documents as ``(doc_id, uid, n, v)``, and ``(v, root)`` of the sets that link.

    Documents with equal sets count once from here on; a set is named by a 64-bit digest.  Sets that
    link share a signature; all who share one meet under the smallest digest among them.  Of those who
    meet, the set that shares the most signatures is the centre.  They are split into blocks of about
    ``BLOCK`` shingles, and each block is searched by T-occurrence: whoever links with the centre is
    connected through it, and whoever does not is searched against the block, and then against every
    other block under that digest.  So no link between components is missed, and the links inside one
    need not all be listed.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", row_key())
    told = stored(_described(docs, k), "jaccard-docs")
    classes = told.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("rep"), F.min("uid").alias("uid"), F.max("n").alias("n"))
    pairs = _meetings(docs, k, num, den).groupBy("c", "v").agg(F.count("*").alias("shared"))
    met = stored(pairs.join(classes, "v").select("c", "v", "shared", "n", "uid"), "jaccard-met")
    wanted = stored(met.select("v", "uid").distinct(), "jaccard-wanted")
    sets = _set_rows(docs, wanted, k)

    size = met.groupBy("c").agg(F.ceil(F.sum(F.col("n").cast("double")) / BLOCK).cast("int").alias("blocks"),
                                F.max_by("v", F.struct("shared", "v")).alias("centre"))
    placed = met.select("c", "v", "n").join(size, "c")
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = (placed.where("centre != v").select("c", "v", own.alias("block"), F.lit(1).alias("role"))
               .unionByName(placed.where("centre = v").select("c", "v", everywhere.alias("block"), F.lit(0).alias("role"))))
    members = stored(members, "jaccard-members")
    edges = stored(_search(sets.join(_few(members.withColumns({"part": F.lit(0), "own": F.col("v")})), "v"), num, den), "jaccard-edges")
    found = connected_components(edges)

    # Of centres with several blocks: whoever is not connected with the centre by now is searched everywhere.
    split = placed.where("blocks > 1")
    root = stored(found, "jaccard-roots")
    apart = (split.join(root, "v", "left").select("c", "v", "n", "blocks", "centre", F.coalesce("root", "v").alias("own"))
             .join(root.select(F.col("v").alias("centre"), F.col("root").alias("centre_root")), "centre", "left")
             .where(F.col("own") != F.coalesce("centre_root", "centre")).select("c", "v", "n", "blocks"))
    apart = stored(apart, "jaccard-apart")
    if not apart.isEmpty():
        parts = apart.groupBy("c").agg(F.ceil(F.sum(F.col("n").cast("double")) / BLOCK).cast("int").alias("parts"))
        asked = apart.join(parts, "c").select("c", "v", everywhere.alias("block"), F.lit(2).alias("role"),
                                              F.pmod(F.xxhash64("v", F.lit(1)), F.col("parts")).cast("int").alias("part"))
        against = members.join(parts, "c").select("c", "v", "block", "role", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        every = against.unionByName(asked.select(against.columns)).join(root, "v", "left").withColumn("own", F.coalesce("root", "v"))
        every = stored(every, "jaccard-asked")
        again = _set_rows(docs, wanted.join(every.select("v").distinct(), "v", "left_semi"), k)
        more = _search(again.join(_few(every), "v"), num, den)
        root = stored(connected_components(edges.unionByName(more)), "jaccard-roots")

    return told, root


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    Words are separated by ASCII white space and A-Z count as lower case.  A document's set holds its
    distinct runs of ``k`` words; with fewer words it holds the whole sequence.  Documents link when
    ``den * |both| >= num * |either|``; ``component_id`` is the smallest id reachable by links.

    Null and blank texts have an empty set and link with nothing, so they stand alone.  Rows that share
    an id are told apart by their sets.  A null id has no part in the minimum; where no other id is
    linked, the component is null.  Other columns are ignored.
    """
    told, root = _linked(docs, k, num, den)
    classes = told.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("rep"))
    named = classes.join(root, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    whole = named.join(least, "root").select("v", "component_id")
    linked = told.where("n > 0").select("doc_id", "n", "v").join(whole, "v", "left")
    alone = told.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (linked.select("doc_id", "n", "component_id").unionByName(alone)
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"))


def jaccard_survivors(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``uid``: the ``row_key`` of one row of each component of ``jaccard_components``, judged by its own set.

    It is the row of the smallest id, nulls last, and then of the smallest key.  Rows with an empty set
    are in no component.
    """
    told, root = _linked(docs, k, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("first")
    sets = told.where("n > 0").groupBy("v").agg(first)
    least = sets.join(root, "v", "left").groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("first").alias("first"))
    return least.select("first.uid")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of three-word shingle sets at 90 per cent, over all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
