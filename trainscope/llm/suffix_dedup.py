"""Repeated passages by sparse suffix arrays: suffixes at minimiser positions, sorted and compared as neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainscope.llm.common import parts_of, small_batches, stored, table
from trainscope.llm.words import Powers, Words, grams, mix, pieces, signed, words_of

#: Words of a minimiser.
K = 8


#: Suffixes of neighbouring keys that a task looks at together.
LOT = 8192


def _anchors(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` k-grams the place of its least one, the first of those that tie."""
    span, at = 1, np.arange(len(g))

    def least(a, b):
        return np.where(g[b] < g[a], b, a)

    while 2 * span <= width:
        at = least(at[:-span], at[span:])
        span *= 2
    rest = width - span
    return least(at[:len(at) - rest], at[rest:]) if rest else at


def _prefix_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and powers, for hashes of any run of words."""
    up, down = Powers.to(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * up[:len(h)], out=total[1:])
    return total, down


def _run_hash(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _scan(docs: DataFrame, least: int) -> DataFrame:
    """The sampled suffixes: key, hash of the words around, document, place, and how far the windows around reach.

    A window belongs to one suffix, that of its least k-gram; ``left`` and ``right`` say how many words
    the windows of a suffix have before and from its start.
    """
    width = least - K + 1

    def scan(batches):
        for batch in batches:
            for piece in pieces(batch):
                words = words_of(piece.column("text"))
                total, down = _prefix_hash(words.hash)
                g = grams(words.hash, K)
                n = max(len(words.hash) - least + 1, 0)
                row = words.rows()[:n]
                inside = np.arange(n) + least <= words.first[row + 1]
                start = np.flatnonzero(inside)  # the windows, by their first word
                at, doc = (_anchors(g, width)[start], row[start]) if n else (start, start)
                new = np.ones(len(start), bool)
                new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
                lead = np.flatnonzero(new)
                last = np.append(lead[1:], len(start))[:len(lead)] - 1
                at, doc, left, right = at[lead], doc[lead], at[lead] - start[lead], start[last] + least - at[lead]
                ctx = _run_hash(total, down, at - left, at + right) + left.astype(np.uint64)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(g[at])), pa.array(signed(ctx)), piece.column("uid").take(take), piece.column("doc_id").take(take)]
                    + [pa.array(x.astype(np.int32)) for x in (at - words.first[doc], left, right)],
                    ["key", "ctx", "uid", "doc_id", "place", "left", "right"])

    return docs.mapInArrow(scan, "key long, ctx long, uid long, doc_id long, place int, left int, right int")


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of the windows around one suffix of each wanted kind: those before it, last first, and its own."""
    def build(batches):
        for batch in batches:
            for piece in pieces(batch):
                words: Words = words_of(piece.column("text"))
                rows = []
                for i, own in enumerate(piece.column("own").to_pylist()):
                    for r in own:
                        p = words.first[i] + r["place"]
                        before = words.hash[p - r["left"]:p][::-1]
                        rows.append((r["key"], r["ctx"], r["low"], r["high"], before.tobytes(), words.hash[p:p + r["right"]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], pa.int64() if j < 4 else pa.binary()) for j in range(6)],
                    ["key", "ctx", "low", "high", "before", "after"])

    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("place", "key", "ctx", "low", "high", "left", "right")).alias("own"))
    texts = docs.select("uid", "text").join(lists, "uid").dropDuplicates(["uid"])
    return texts.mapInArrow(build, "key long, ctx long, low long, high long, before binary, after binary")


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) // 8 for v in values])
    out = np.zeros((len(values), width), np.uint64)
    out[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(values), np.uint64)
    return out, size


def _common(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the next."""
    same = (x[:-1] == x[1:]) & (np.arange(x.shape[1]) < np.minimum(size[:-1], size[1:])[:, None])
    return np.where(same.all(1), x.shape[1], np.argmin(same, axis=1))


_FOUND = "key long, ctx long, first int, last int, reach int, low_open int, high_open int"


def _compare(sorted_: DataFrame, least: int, lot: int) -> DataFrame:
    """What neighbours in the order share: ranges of windows that repeat, and for each suffix what is left open.

    Window j has j words before the suffix and ``least - j`` from it on.  Rows with ``first`` say that
    the windows first..last of the suffix repeat in another document.  No suffix shares more words from
    its start on than a neighbour in the order does, so only windows within that reach can repeat; those
    that neighbours do not settle are compared by hash among the suffixes of their key, if a lot of
    ``lot`` rows holds all of them.  For keys on the edge of a lot the other rows give the reach and the
    windows left open, if any.  At the ends of a partition a neighbour is missing, so the reach is
    unknown and all windows count as possible.
    """
    width = least - K + 1

    def lots(batches):
        held, kept, n = None, [], 0
        for batch in batches:
            kept, n = [*kept, batch], n + batch.num_rows
            if n < lot:
                continue
            whole, kept, n = pa.Table.from_batches(kept).combine_chunks().to_batches()[0], [], 0
            for i in range(0, whole.num_rows, lot):
                part = whole.slice(i, lot)
                yield pa.Table.from_batches([held, part] if held else [part]).combine_chunks().to_batches()[0], held is None
                held = part.slice(part.num_rows - 1, 1)
        if n:
            part = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            yield pa.Table.from_batches([held, part] if held else [part]).combine_chunks().to_batches()[0], held is None
            held = part.slice(part.num_rows - 1, 1)
        if held:
            yield held, None

    def compare(batches):
        carried = None  # state of the last row of a lot, which the next one completes
        for batch, begins in lots(batches):
            if begins is None:
                yield from settle(batch, *carried[:2], np.array([True]), np.array([True]))
                return
            key, low, high = (batch.column(c).to_numpy() for c in ("key", "low", "high"))
            (after, n_after), (before, n_before) = _matrix(batch.column("after").to_pylist(), least), _matrix(batch.column("before").to_pylist(), width - 1)
            reach, covered, n = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, width), bool), batch.num_rows
            if carried:
                reach[0], covered[0] = carried[0][0], carried[1][0]
            if n > 1:
                same = key[:-1] == key[1:]
                r = np.where(same, _common(after, n_after), 0)
                l = np.where(same, _common(before, n_before), 0)
                np.maximum(reach[:-1], r, out=reach[:-1])
                np.maximum(reach[1:], r, out=reach[1:])
                across = np.minimum(low[:-1], low[1:]) != np.maximum(high[:-1], high[1:])
                j = np.arange(width)
                both = (j >= least - r[:, None]) & (j <= l[:, None]) & across[:, None]
                covered[:-1] |= both
                covered[1:] |= both
            edge = (key == key[0]) | (key == key[-1])
            inner = np.flatnonzero(~edge)
            if len(inner):
                possible = _possible(reach[inner], n_before[inner], least)
                left_open = possible & ~covered[inner] & (low == high)[inner, None]
                _, of = np.unique(key[inner], return_inverse=True)
                asked = np.zeros((of.max() + 1, width), bool)
                np.logical_or.at(asked, of, left_open)
                at, window = np.nonzero(possible & asked[of])
                if len(at):
                    at = inner[at]
                    _, which = np.unique(_hashes(before, after, at, window, least), return_inverse=True)
                    least_low, most_high = np.full(which.max() + 1, np.iinfo(np.int64).max), np.full(which.max() + 1, np.iinfo(np.int64).min)
                    np.minimum.at(least_low, which, low[at])
                    np.maximum.at(most_high, which, high[at])
                    twice = (least_low != most_high)[which]
                    covered[at[twice], window[twice]] = True
            done = np.zeros(n, bool)
            done[0] = begins or carried[2]
            if n > 1:
                yield from settle(batch.slice(0, n - 1), reach[:-1], covered[:-1], done[:-1], edge[:-1])
            carried = (reach[-1:], covered[-1:], n == 1 and done[0])

    def settle(batch, reach, covered, alone, edge):
        single = batch.column("low").to_numpy() == batch.column("high").to_numpy()
        n_before, n_after = (np.array([len(v) // 8 for v in batch.column(c).to_pylist()]) for c in ("before", "after"))
        reach = np.where(alone, n_after, reach)
        left_open = _possible(reach, n_before, least) & ~covered & (edge & single)[:, None]
        some = left_open.any(1)
        side = np.zeros((len(reach), 1), np.int8)
        step = np.diff(np.concatenate([side, covered.astype(np.int8), side], axis=1), axis=1)
        row, first = np.nonzero(step == 1)
        _, last = np.nonzero(step == -1)
        use = single[row]  # the windows of others repeat as they are
        row, first, last = row[use], first[use], last[use]
        rest = np.flatnonzero(edge)
        every = np.concatenate([row, rest])
        told, blank = np.arange(len(every)) < len(row), np.zeros(len(rest), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column(c).to_numpy()[every]) for c in ("key", "ctx")]
            + [pa.array(np.concatenate([x, blank]).astype(np.int32), mask=~told) for x in (first, last - 1)]
            + [pa.array(reach[every].astype(np.int32), mask=told)]
            + [pa.array(x[every].astype(np.int32), mask=told | ~some[every]) for x in (left_open.argmax(1), width - 1 - left_open[:, ::-1].argmax(1))],
            ["key", "ctx", "first", "last", "reach", "low_open", "high_open"])

    return sorted_.mapInArrow(compare, _FOUND)


def _possible(reach: np.ndarray, n_before: np.ndarray, least: int) -> np.ndarray:
    j = np.arange(least - K + 1)
    return (j >= least - reach[:, None]) & (j <= n_before[:, None])


def _hashes(before: np.ndarray, after: np.ndarray, at: np.ndarray, window: np.ndarray, least: int) -> np.ndarray:
    """Hash of window ``window`` of suffix ``at``, from the words before the suffixes (last first) and their own."""
    line = np.concatenate([before[:, ::-1], after], axis=1)
    start = before.shape[1] - window
    total = np.zeros(len(at), np.uint64)
    for c in range(least):
        total = total * np.uint64(0x9E3779B97F4A7C15) + line[at, start + c]
    return mix(total)


def _windows(rows: DataFrame, least: int) -> DataFrame:
    """The hash of each window within reach of its suffix that is open for some suffix of the key."""
    width = least - K + 1

    def hashes(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                after, _ = _matrix(batch.column("after").to_pylist(), least)
                before, n_before = _matrix(batch.column("before").to_pylist(), width - 1)
                reach, low_open, high_open = (batch.column(c).to_numpy()[:, None] for c in ("reach", "low_open", "high_open"))
                j = np.arange(width)
                at, window = np.nonzero(_possible(reach[:, 0], n_before, least) & (j >= low_open) & (j <= high_open))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(c).to_numpy()[at]) for c in ("key", "ctx", "low", "high")]
                    + [pa.array(window.astype(np.int32)), pa.array(signed(_hashes(before, after, at, window, least)))],
                    ["key", "ctx", "low", "high", "j", "window"])

    return rows.mapInArrow(hashes, "key long, ctx long, low long, high long, j int, window long")


def repeated_passages(docs: DataFrame, least: int = 50, lot: int = LOT) -> DataFrame:
    """``(doc_id, first_word, end_word, n_words)``: maximal runs covered by passages of ``least`` words that another document has.

    Words are separated by ASCII white space, A-Z as lower case; ``end_word`` is exclusive.  A passage
    that repeats only inside one document is not reported; rows with equal id and text are one
    document.  Texts that are null or shorter than ``least`` words have no passages; no passages give no
    rows.  ``least`` is at least 9.  ``lot`` decides memory and speed only.

    Suffixes begin at the minimisers of each ``least`` words: the first place whose run of eight words
    has the least hash.  Documents that share a passage share its minimiser and the words around.
    Suffixes whose windows are the same words are one from here on, and in several documents they repeat
    as they are.  Keys that have others too are sorted by their words over ranges, so a frequent
    minimiser is split by what follows it; neighbours are compared to the right and extended to the
    left.  What the order of neighbours cannot settle is compared by the hash of the ``least`` words:
    inside the task if all suffixes of the key are there, else over a shuffle of the windows in doubt.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("uid"))
    anchors = stored(_scan(docs, least), "suffix-anchors")
    kinds = stored(anchors.groupBy("key", "ctx").agg(
        F.min("uid").alias("low"), F.max("uid").alias("high"), F.min_by("place", "uid").alias("place"),
        F.first("left").alias("left"), F.first("right").alias("right")), "suffix-kinds")
    whole = kinds.where("low != high").select("key", "ctx", (F.lit(least) - F.col("right")).alias("first"), F.col("left").alias("last"))

    shared = kinds.groupBy("key").agg(F.count("*").alias("n"), F.min("low").alias("a"), F.max("high").alias("b"), F.max(F.expr("low = high")).alias("single"))
    shared = shared.where("n > 1 and a != b and single")
    wanted = kinds.join(shared.select("key"), "key").select(F.col("low").alias("uid"), "place", "key", "ctx", "low", "high", "left", "right")
    around = stored(_surroundings(docs, wanted), "suffix-words")
    order = around.repartitionByRange(parts_of(docs.sparkSession), "key", "after", "before").sortWithinPartitions("key", "after", "before")
    found = stored(_compare(order, least, lot), "suffix-found")
    near = found.where("first is not null").select("key", "ctx", "first", "last")
    told = found.where("first is null")
    doubtful = told.groupBy("key").agg(F.min("low_open").alias("low_open"), F.max("high_open").alias("high_open")).where("low_open is not null")
    doubtful = told.select("key", "ctx", "reach").join(doubtful, "key")
    asked = stored(_windows(around.join(doubtful, ["key", "ctx"]).select("key", "ctx", "low", "high", "before", "after", "reach", "low_open", "high_open"), least), "suffix-windows")
    again = asked.groupBy("window").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a != b").select("window")
    looked = asked.where("low = high").join(again, "window").select("key", "ctx", F.col("j").alias("first"), F.col("j").alias("last"))

    settled = whole.unionByName(near).unionByName(looked)
    spans = anchors.select("key", "ctx", "doc_id", "uid", "place").join(settled, ["key", "ctx"]).select(
        "doc_id", "uid", (F.col("place") - F.col("last")).alias("first"), (F.col("place") - F.col("first") + least).alias("end"))
    lists = spans.groupBy("doc_id", "uid").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))
    run = "array<struct<first:int,end:int>>"

    def join(done, span):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(done) > 0) & (last["end"] >= span["first"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    merged = lists.select("doc_id", F.explode(F.aggregate("spans", F.array().cast(run), join)).alias("s"))
    return merged.select("doc_id", F.col("s.first").alias("first_word"), F.col("s.end").alias("end_word"), (F.col("s.end") - F.col("s.first")).alias("n_words"))


def op3_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share."""
    return repeated_passages(table(spark, sf_dir, "documents"))
