"""The trie of conversation prefixes, with totals of every subtree by tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.llm.common import parts_of, small_batches, stored, table
from trainscope.llm.contraction import subtree_sums

#: Ids that travel as one piece of a node's list.
IDS = 4096

# A prefix is named by the sum of its turns' hashes times powers of an odd base, modulo 2^64, and by a second such
# sum: names of following stretches are added up in any order, so no conversation must be in one task.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MOD = 1 << 64
_EMPTY = hashlib.sha256(b"").hexdigest()


def _long(x: int) -> int:
    return x - _MOD if x >= _MOD >> 1 else x


def _numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, part, i, a, b, pa, pb, chars)``: turns in order, numbered and named within each stretch of a conversation.

    Texts stay where they are: only their hashes are sorted, over all tasks, so a long conversation, or
    a turn that is repeated very often, runs through several of them.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.length(text).cast("long").alias("chars"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "digest", "row"]
    powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(1 << 16, x, np.uint64)])) for x in _BASES]

    def number(batches):
        part = TaskContext.get().partitionId()
        conv, count, sums, power = None, 0, [0, 0], [1, 1]
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            i, named = np.zeros(len(ids), np.int64), [np.zeros(len(ids), np.uint64) for _ in range(4)]
            t = [batch.column(c).to_numpy().view(np.uint64) for c in "ab"]
            for first, end in zip(cuts, cuts[1:]):
                if ids[first] != conv:
                    conv, count, sums, power = ids[first], 0, [0, 0], [1, 1]
                i[first:end] = np.arange(count + 1, count + 1 + end - first)
                for k in range(2):
                    own = t[k][first:end] * (powers[k][1:end - first + 1] * np.uint64(power[k]))
                    total = np.cumsum(own) + np.uint64(sums[k])
                    named[k][first:end], named[k + 2][first:end] = total, total - own
                    sums[k], power[k] = int(total[-1]), int(powers[k][end - first]) * power[k] % _MOD
                count += end - first
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "part": pa.array(np.full(len(ids), part), pa.int32()), "i": pa.array(i), "chars": batch.column("chars"),
                **{c: pa.array(x.view(np.int64)) for c, x in zip(("a", "b", "pa", "pb"), named)}})

    return narrow.repartitionByRange(parts_of(turns.sparkSession), *order).sortWithinPartitions(*order).drop("turn", "role", "digest", "row").mapInArrow(
        number, "conv_id long, part int, i long, chars long, a long, b long, pa long, pb long")


def _positions(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, a, b, pa, pb, chars)``: numbers and names from the start of each conversation.

    A conversation that goes on in another task is the first or last of it, so at most two for each
    task need the counts and names of their stretches before.
    """
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    crossing = edges.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id")).groupBy("conv_id").count().where("count > 1")
    stretches = (rows.join(crossing, "conv_id", "left_semi").groupBy("conv_id", "part")
                 .agg(F.max("i").alias("n"), F.max_by("a", "i").alias("a"), F.max_by("b", "i").alias("b")).orderBy("conv_id", "part").collect())
    before: dict[tuple[int, int], tuple] = {}
    conv, count, sums = None, 0, [0, 0]
    for r in stretches:  # at most two for each task
        if r["conv_id"] != conv:
            conv, count, sums = r["conv_id"], 0, [0, 0]
        factors = [pow(x, count, _MOD) for x in _BASES]
        before[conv, r["part"]] = (count, *sums, *factors)
        sums = [(s + f * (r[c] % _MOD)) % _MOD for s, f, c in zip(sums, factors, "ab")]
        count += r["n"]

    def place(batches):
        for batch in batches:
            ids, parts, i = (batch.column(c).to_numpy() for c in ("conv_id", "part", "i"))
            pos = i.copy()
            named = {c: batch.column(c).to_numpy().view(np.uint64).copy() for c in ("a", "b", "pa", "pb")}
            for at in _found(ids, parts, before):
                count, sum_a, sum_b, factor_a, factor_b = before[int(ids[at[0]]), int(parts[at[0]])]
                pos[at] += count
                for c, s, f in (("a", sum_a, factor_a), ("b", sum_b, factor_b), ("pa", sum_a, factor_a), ("pb", sum_b, factor_b)):
                    named[c][at] = named[c][at] * np.uint64(f) + np.uint64(s)
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "pos": pa.array(pos), "chars": batch.column("chars"),
                                              **{c: pa.array(x.view(np.int64)) for c, x in named.items()}})

    return rows.mapInArrow(place, "conv_id long, pos long, chars long, a long, b long, pa long, pb long")


def _found(ids: np.ndarray, parts: np.ndarray, asked: dict[tuple[int, int], tuple]) -> Iterator[np.ndarray]:
    """Places of the rows of each asked conversation and part."""
    for part in np.unique(parts).tolist():
        for conv in (c for c, p in asked if p == part):
            at = np.flatnonzero((ids == conv) & (parts == part))
            if len(at):
                yield at


def _conversations(rows: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """``(conv_id, n, cut, own, heads)``: turns of a conversation, how many of them go, its first ones, and those it gets instead."""
    first = F.when(F.col("pos") <= most, F.struct("pos", "a", "b", "chars"))
    per = rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(first)).alias("own"))
    bases = per.select(F.col("conv_id").alias("base"), F.col("own").alias("heads"))
    told = per.select("conv_id", "n", "own", base.cast("long").alias("base"), head.cast("int").alias("cut")).join(bases, "base", "left")
    none = F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,chars:bigint>>")
    return told.select("conv_id", "n", "cut", "own", F.slice(F.coalesce("heads", none), 1, F.col("cut")).alias("heads"))


_MEMBER = "conv_id long, depth long, a long, b long, pa long, pb long, chars long, last boolean"


def _members(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and each of its prefixes, the empty one included."""
    ends_in_head = F.col("n") <= F.col("cut")
    heads = F.size("heads")
    code = lambda c, i, array: F.when(i < 1, F.lit(0).cast("long")).otherwise(F.get(array, i - 1)[c])
    nothing = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), nothing.alias("pa"), nothing.alias("pb"),
                                 zero.alias("chars"), ((heads == 0) & ends_in_head).alias("last"))
    given = conversations.where(heads > 0).select("conv_id", "n", "cut", "heads", F.explode("heads").alias("turn")).select(
        "conv_id", F.col("turn.pos").alias("depth"), F.col("turn.a").alias("a"), F.col("turn.b").alias("b"),
        *(code(c, F.col("turn.pos").cast("int") - 1, "heads").alias(f"p{c}") for c in "ab"), F.col("turn.chars").alias("chars"),
        ((F.col("turn.pos") == heads) & ends_in_head).alias("last"))
    moved = conversations.select("conv_id", "n", "cut", heads.alias("n_heads"),
                                 *(code(c, heads, "heads").alias(f"head_{c}") for c in "ab"),
                                 *(code(c, F.least("cut", F.size("own")), "own").alias(f"cut_{c}") for c in "ab"))
    kept = rows.join(moved, "conv_id").where("pos > cut")

    def rename(batches):
        for batch in batches:
            get = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            back = (get["cut"] - get["n_heads"]).astype(np.int64)
            out = {}
            for c, base in zip("ab", _BASES):
                inverse = pow(base, -1, _MOD)
                table_ = np.array([pow(inverse, k, _MOD) for k in range(int(back.max(initial=0)) + 1)], np.uint64)
                start, before = get[f"head_{c}"].view(np.uint64), get[f"cut_{c}"].view(np.uint64)
                for name in (c, f"p{c}"):
                    out[name] = pa.array((start + (get[name].view(np.uint64) - before) * table_[back]).view(np.int64))
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "depth": pa.array(get["pos"] - back), **out, "chars": batch.column("chars"),
                                              "last": pa.array(get["pos"] == get["n"])})

    own = kept.mapInArrow(rename, "conv_id long, depth long, a long, pa long, b long, pb long, chars long, last boolean")
    return roots.unionByName(given).unionByName(own)


def _ends(members: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)`` of nodes where conversations end.

    Ids are sorted over all tasks and joined into pieces there; the pieces of a node then pass its
    hash one by one, so no list is held whole, however many copies a conversation has.
    """
    ends = members.where("last").select("a", "b", "conv_id")

    def join(batches):
        key, ids = None, []

        def piece():
            return pa.RecordBatch.from_pydict({"a": pa.array([key[0]], pa.int64()), "b": pa.array([key[1]], pa.int64()),
                                               "first": pa.array([ids[0]], pa.int64()), "text": pa.array([",".join(map(str, ids))])})

        for batch in batches:
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id"))):
                if ids and (key != (a, b) or len(ids) == IDS):
                    yield piece()
                    ids = []
                key = (a, b)
                ids.append(conv)
        if ids:
            yield piece()

    def batched(make):
        def run(batches):
            held = []
            for batch in make(batches):
                held.append(batch)
                if len(held) == 500:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return run

    def digest(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_pydict({"a": pa.array([key[0]], pa.int64()), "b": pa.array([key[1]], pa.int64()),
                                               "ends_sha256": pa.array([state.hexdigest()])})

        for batch in batches:
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text"))):
                if key == (a, b):
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    yield row()
                key, state = (a, b), hashlib.sha256(text.encode())
        if key is not None:
            yield row()

    parts, order = parts_of(members.sparkSession), ["a", "b", "conv_id"]
    pieces = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(batched(join), "a long, b long, first long, text string")
    return pieces.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "text").mapInArrow(
        batched(digest), "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """The trie of all conversations of ``turns(conv_id, turn, role, text)``, each rebuilt on the start of another.

    ``base`` is a conversation's base and ``head`` how many first turns it takes from there, both by
    ``conv_id``; ``head`` is at most ``most``.  Its own first ``head`` turns go, and those of the base come in
    their place: all of them if the base has fewer, none if there is no such conversation.

    One row a node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (code points that a cache of prefixes saves in the subtree) and
    ``ends_sha256`` over the ids that end there.  Equal turn numbers, nulls first, go by role, then by the md5 of the
    text; repeated rows are turns of their own.  A null role or text counts as empty.  Rows without
    ``conv_id`` belong to no conversation; an empty table gives no rows, any other a root.

    Prefixes are told apart by 128 bits.  Conversations, copies and children of a node may each hold any
    share of the rows: numbering, lists and totals run over all tasks.
    """
    small_batches(turns.sparkSession)
    rows = _positions(stored(_numbered(turns), "trie-turns"))
    members = stored(_members(rows, _conversations(rows, base, head, most)), "trie-members")
    nodes = members.groupBy("a", "b").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                                          F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    linked = nodes.join(above, ["pa", "pb"], "left").join(kids, ["a", "b"], "left").fillna(0, ["n_children"])
    linked = stored(linked, "trie-linked")
    sums = subtree_sums(linked.select("id", "parent", F.col("n_children").alias("kids"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                                      ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    return (linked.join(sums, "id").join(_ends(members), ["a", "b"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of ``conversations``, each on the first turns of the conversation that begins its hundred."""
    conv = F.col("conv_id").cast("long")
    return prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)


SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS item,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(item ORDER BY pos) AS turns FROM t GROUP BY conv_id),
x AS (
  SELECT *, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
    lambda v, z: list_reduce([xor(v, z), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, w: CASE WHEN u & 1 = 1 THEN xor(u >> 1, CAST(3988292384 AS BIGINT)) ELSE u >> 1 END)) AS crc
  FROM c),
h AS (SELECT *, CAST(xor(crc, CAST(4294967295 AS BIGINT)) % 6 AS BIGINT) AS h, conv_id - conv_id % 100 AS base FROM x),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN c b ON b.conv_id = h.base),
m AS (SELECT conv_id, turns, CAST(unnest(range(0, len(turns) + 1)) AS BIGINT) AS depth FROM r),
k AS (SELECT conv_id, depth, turns[1:depth] AS path, depth = len(turns) AS last FROM m),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM k GROUP BY depth, path),
p AS (
  SELECT n.*, q.conv_id AS parent_conv_id FROM n LEFT JOIN n q ON q.depth = n.depth - 1 AND q.path = n.path[1:n.depth - 1]),
f AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
w AS (
  SELECT p.*, coalesce(f.n_children, 0) AS n_children, CASE WHEN p.depth = 0 THEN 0 ELSE (n_convs - 1) * length(p.path[p.depth].text) END AS saved
  FROM p LEFT JOIN f ON f.depth = p.depth AND f.path = p.path),
u AS (SELECT path, n_children, saved, unnest(range(0, depth + 1)) AS up FROM w),
s AS (SELECT up AS depth, path[1:up] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY 1, 2)
SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.depth = w.depth AND s.path = w.path
"""
