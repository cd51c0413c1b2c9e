"""Process stack snapshots: pairing consecutive samples of a check and finding what moved.

A snapshot table has ``node, snapshot_no, snapshot_time, pid, rank, type,
threads``; ``snapshot_time`` is text and ``threads`` an array of
``struct<thread_id, thread_name, stack_frames>``.  Pids are unique within one
sample of a node.  A ``check_id`` column, where there is one, keeps the samples
of several checks of a node apart; without it a node has one check.

Samples may also be given as facts (node, check and number of every sample
taken), since a sample without processes leaves no row in the table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.functions.stacks import process_type_name
from trainscope.operators.skew import spread_join
from trainscope.session import stored

# --- Fixed values: texts of differences and errors -----------------------------
THREAD_COUNT_TEXT = ("Detected different number of threads in process stack. %s, Process type: %s, Process ID:%d\n"
                     "[%s]Thread count: %d\n[%s]Thread count: %d\n")
THREAD_ID_TEXT = ("Detected different thread IDs. %s, Process type: %s, Process ID:%d\n"
                  "[%s]Thread ID: %d\n[%s]Thread ID: %d\n")
FRAME_COUNT_TEXT = ("Detected different number of thread stack frames. %s, Process type: %s, Process ID:%d, Thread ID: %d\n"
                    "[%s]Frame count: %d\n[%s]Frame count: %d\n")
FRAME_TEXT = ("Detected different process stacks. %s, Process type: %s, Process ID:%d, Thread ID: %d, Stack frame level: %d\n"
              "[%s]Stack frame content: %s\n[%s]Stack frame content: %s\n")
COUNT_ERROR = "process count mismatch: psa: %d, psb: %d"
RANK_ERROR = "process ranks are different: %s and %s"
PID_ERROR = "internal error, comparing two different processes. pid: %d and %d"


def pair_keys(snaps: DataFrame) -> list[str]:
    """What names a sample, and the pair that it makes with the one before."""
    return ["node", *(["check_id"] if "check_id" in snaps.columns else []), "snapshot_no"]


def _later(keys: list[str]) -> list[Column]:
    """The pair in which a sample is the old side."""
    return [*(F.col(k) for k in keys[:-1]), (F.col("snapshot_no") + 1).alias("snapshot_no")]


def previous_snapshot(snaps: DataFrame) -> DataFrame:
    """Each process row with its stack in the sample before, joined on equal keys.

    The key has the sample number in it, so a process with a long history is no
    hot key, as it would be in a window over the process.
    """
    keys = pair_keys(snaps)
    before = snaps.select(*_later(keys), "pid", F.col("threads").alias("previous_threads"))
    return snaps.join(before, [*keys, "pid"], "left")


def stack_hash(threads: Column | str) -> Column:
    """One number for a process's threads in id order and their frames; case does not count."""
    threads = F.col(threads) if isinstance(threads, str) else threads
    ordered = F.sort_array(F.arrays_zip(threads["thread_id"].alias("id"), threads["stack_frames"].alias("frames")))
    return F.xxhash64(F.lower(F.to_json(ordered)))


class Comparison(NamedTuple):
    """What one pass over the snapshots tells about every pair of samples."""

    pairs: DataFrame  # the pairs, by ``pair_keys``
    errors: DataFrame  # with ``error``: pairs that cannot be compared
    moved: DataFrame  # with ``pid``: processes of the other pairs whose stack is not the same


def compare_samples(snaps: DataFrame, samples: DataFrame | None = None) -> Comparison:
    """Pairs of consecutive samples of a check, why some cannot be compared, and whose stacks moved.

    The snapshots are read once, and of each process only a hash of its stack is shuffled.  Stacks
    that moved are fetched later by key, and most stacks of a hung job have not.

    Processes are matched in pid order; the first position that does not fit
    decides.  That position is found from two minima instead of numbering a
    node's processes: up to the smallest pid missing on one side both sides are
    equal, and at that position each side holds its smallest pid from there on.

    With ``samples`` a sample that was taken and is empty is compared too.
    """
    keys = pair_keys(snaps)
    role = F.explode(F.array(*(F.struct((F.col("snapshot_no") + step).alias("pair"), F.lit(step == 0).alias("is_now")) for step in (0, 1))))
    roles = snaps.select(*keys[:-1], "snapshot_no", "pid", "rank", stack_hash("threads").alias("stack")).select(
        *keys[:-1], "pid", "rank", "stack", role.alias("_p")).select(
        *keys[:-1], F.col("_p.pair").alias("snapshot_no"), "pid", "rank", "stack", F.col("_p.is_now").alias("is_now"))
    side = lambda now, c: F.when(F.col("is_now") == now, F.col(c))
    by_pid = stored(roles.groupBy(*keys, "pid").agg(
        F.count(side(True, "pid")).alias("n_now"), F.count(side(False, "pid")).alias("n_then"),
        F.max(side(True, "rank")).alias("now_rank"), F.max(side(False, "rank")).alias("then_rank"),
        F.max(side(True, "stack")).alias("now_stack"), F.max(side(False, "stack")).alias("then_stack")), "processes-of-pairs")
    alone = (F.col("n_now") == 0) | (F.col("n_then") == 0)
    other_rank = F.lower("now_rank") != F.lower("then_rank")
    per_pair = by_pid.groupBy(*keys).agg(
        F.sum("n_now").alias("n_now"), F.sum("n_then").alias("n_then"),
        F.min(F.when(alone, F.col("pid"))).alias("gap"),
        F.min(F.when(other_rank, F.struct("pid", "now_rank", "then_rank"))).alias("clash"))
    if samples is None:
        per_pair = per_pair.filter("n_now > 0 and n_then > 0")
    else:
        taken = samples.select(*keys).distinct()
        both = taken.join(taken.select(*_later(keys)), keys, "left_semi")
        per_pair = both.join(per_pair, keys, "left").fillna(0, ["n_now", "n_then"])
    per_pair = stored(per_pair, "pairs")
    gaps = per_pair.filter("n_now = n_then and gap is not null").select(*keys, "gap")
    held = lambda now: F.when(F.col("n_now" if now else "n_then") > 0, F.struct(
        F.col("pid"), F.col("now_rank" if now else "then_rank").alias("rank")))
    at_gap = (spread_join(by_pid, gaps, keys, ["pid"]).filter("pid >= gap").groupBy(*keys)
              .agg(F.min(held(True)).alias("a"), F.min(held(False)).alias("b")))
    clash_first = F.col("clash").isNotNull() & (F.col("gap").isNull() | (F.col("clash.pid") < F.col("gap")))
    error = (F.when(F.col("n_now") != F.col("n_then"), F.format_string(COUNT_ERROR, "n_now", "n_then"))
             .when(clash_first, F.format_string(RANK_ERROR, "clash.now_rank", "clash.then_rank"))
             .when(F.lower("a.rank") != F.lower("b.rank"), F.format_string(RANK_ERROR, "a.rank", "b.rank"))
             .when(F.col("gap").isNotNull(), F.format_string(PID_ERROR, "a.pid", "b.pid")))
    errors = stored(per_pair.join(at_gap, keys, "left").select(*keys, error.alias("error")).filter("error is not null"), "pair-errors")
    moved = spread_join(by_pid.filter("now_stack <> then_stack").select(*keys, "pid"), errors.select(*keys), keys, ["pid"], "left_anti")
    return Comparison(per_pair.select(*keys), errors, moved)


def pair_errors(snaps: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Pairs of samples that cannot be compared, and why.  At most one row per node and pair.

    A pair is any sample of a check and the one before it, if both were taken.
    """
    return compare_samples(snaps, samples).errors


def snapshot_pairs(snaps: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Processes of consecutive samples side by side, comparable pairs only."""
    keys = pair_keys(snaps)
    held = F.struct("pid", "snapshot_time", "rank", "type", "threads")
    now = snaps.select(*keys, "pid", held.alias("now"))
    then = snaps.select(*_later(keys), "pid", held.alias("then"))
    wrong = pair_errors(snaps) if errors is None else errors
    return spread_join(now.join(then, [*keys, "pid"]), wrong.select(*keys), keys, ["pid"], "left_anti")


def moved_pairs(snaps: DataFrame, compared: Comparison | None = None) -> DataFrame:
    """The rows of ``snapshot_pairs`` whose stacks are not the same; only those stacks are fetched and shuffled."""
    keys = pair_keys(snaps)
    moved = (compare_samples(snaps) if compared is None else compared).moved
    role = F.explode(F.array(*(F.struct((F.col("snapshot_no") - step).alias("at"), F.lit(step == 0).alias("is_now")) for step in (0, 1))))
    asked = moved.select(*keys[:-1], F.col("snapshot_no").alias("_pair"), "pid", role.alias("_p")).select(
        *keys[:-1], "_pair", "pid", F.col("_p.at").alias("snapshot_no"), F.col("_p.is_now").alias("_is_now"))
    held = F.struct("pid", "snapshot_time", "rank", "type", "threads")
    stacks = snaps.select(*keys, "pid", held.alias("_held")).join(asked, [*keys, "pid"])
    side = lambda now: F.first(F.when(F.col("_is_now") == now, F.col("_held")), ignorenulls=True)
    return (stacks.groupBy(*keys[:-1], "_pair", "pid").agg(side(True).alias("now"), side(False).alias("then"))
            .select(*keys[:-1], F.col("_pair").alias("snapshot_no"), "pid", "now", "then"))


def _sorted_threads(threads: Column) -> Column:
    return F.sort_array(F.arrays_zip(threads["thread_id"].alias("id"), threads["stack_frames"].alias("frames")))


def compare_threads(pairs: DataFrame) -> DataFrame:
    """First difference of each process as text; rows without one are dropped.

    Checked in this order: number of threads, then thread by thread in id order
    the id, the number of frames and the frames, ignoring case.
    """
    keys = pair_keys(pairs)
    shaped = pairs.select(
        *keys, "pid", F.col("now.rank").alias("rank"), F.col("now.type").alias("type"),
        process_type_name("now.type").alias("kind"),
        F.col("now.snapshot_time").alias("t1"), F.col("then.snapshot_time").alias("t2"),
        _sorted_threads(F.col("now.threads")).alias("a"), _sorted_threads(F.col("then.threads")).alias("b"))
    # Most stacks of a hung job are identical: drop them before any text work.
    moved = shaped.filter(F.col("a") != F.col("b"))
    head = ["rank", "kind", "pid"]

    def frame_diff(x: Column, y: Column) -> Column:
        def at(frame: Column, i: Column) -> Column:
            other = F.get(y["frames"], i)
            return F.when(F.lower(frame) != F.lower(other), F.format_string(
                FRAME_TEXT, *head, x["id"], i + 1, "t1", frame, "t2", other))
        return F.get(F.filter(F.transform(x["frames"], at), lambda d: d.isNotNull()), F.lit(0))

    def thread_diff(x: Column, y: Column) -> Column:
        return (F.when(x["id"] != y["id"], F.format_string(THREAD_ID_TEXT, *head, "t1", x["id"], "t2", y["id"]))
                .when(F.size(x["frames"]) != F.size(y["frames"]), F.format_string(
                    FRAME_COUNT_TEXT, *head, x["id"], "t1", F.size(x["frames"]), "t2", F.size(y["frames"])))
                .otherwise(frame_diff(x, y)))

    first = F.get(F.filter(F.zip_with("a", "b", thread_diff), lambda d: d.isNotNull()), F.lit(0))
    diff = F.when(F.size("a") != F.size("b"), F.format_string(
        THREAD_COUNT_TEXT, *head, "t1", F.size("a"), "t2", F.size("b"))).otherwise(first)
    return (moved.select(*keys, "pid", "rank", "type", diff.alias("diff"))
            .filter(F.col("diff").isNotNull()))


Rule = Callable[[DataFrame], DataFrame]


def stack_diffs(snaps: DataFrame, rule: Rule = compare_threads, errors: DataFrame | None = None,
                compared: Comparison | None = None) -> DataFrame:
    """Differences by a rule: a function of the pairs giving ``rank, diff, type`` rows.

    The library's own rule sees only the pairs whose stacks moved; any other rule sees all.
    """
    if rule is compare_threads and (compared is not None or errors is None):
        return rule(moved_pairs(snaps, compared))
    return rule(snapshot_pairs(snaps, errors if compared is None else compared.errors))


def snapshot_verdict(snaps: DataFrame, diffs: DataFrame, errors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``haveDiff`` or ``noDiff`` per node and sample whose predecessor was taken too; an error counts as a difference."""
    keys = pair_keys(snaps)
    if pairs is None:
        taken = snaps.select(*keys).distinct()
        pairs = taken.join(taken.select(*_later(keys)), keys, "left_semi")
    found = diffs.groupBy(*keys).agg(F.count("*").alias("diffs"))
    out = pairs.join(found, keys, "left").join(errors, keys, "left")
    same = F.col("diffs").isNull() & F.col("error").isNull()
    return out.select(*keys, F.when(same, F.lit("noDiff")).otherwise(F.lit("haveDiff")).alias("verdict"),
                      F.coalesce("diffs", F.lit(0).cast("bigint")).alias("diffs"), "error")


def sample_verdicts(snaps: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """The verdicts of all pairs, from one comparison."""
    compared = compare_samples(snaps, samples)
    return snapshot_verdict(snaps, stack_diffs(snaps, compared=compared), compared.errors, compared.pairs)


def stacks_for_suspects(snaps: DataFrame, suspects: DataFrame) -> DataFrame:
    """All processes of the suspicious nodes, whichever rank gave them away."""
    return spread_join(snaps, suspects.select("node").distinct(), ["node"], ["pid", "snapshot_no"], "left_semi")
