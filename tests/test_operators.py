import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trainscope.operators import events as E
from trainscope.operators import fleet as V
from trainscope.operators import logs as L
from trainscope.operators import processes as P
from trainscope.operators import skew as K
from trainscope.operators import snapshots as S

UTC = dt.timezone.utc
LINE = "node string, rank_no int, rank string, line_no bigint, line string, file_mtime timestamp"


def lines(spark, rows):
    mtime = dt.datetime(2025, 7, 11, 2, 32, 53, tzinfo=UTC)
    return spark.createDataFrame([("n0", r, f"RANK{r}", i, text, mtime) for r, i, text in rows], LINE)


@pytest.mark.parametrize("total, n", [(20, 10), (10, 5), (3, 5)])
def test_tail(spark, total, n):
    df = lines(spark, [(0, i, f"Line {i}") for i in range(total)])
    got = [r.line for r in L.tail_lines(df, n).orderBy("line_no").collect()]
    assert got == [f"Line {i}" for i in range(max(0, total - n), total)]


def test_tail_needs_a_positive_number(spark):
    with pytest.raises(ValueError):
        L.tail_lines(lines(spark, [(0, 0, "x")]), 0)


def test_tail_with_one_hot_rank_in_many_tasks(spark):
    df = (spark.range(0, 200_000, 1, 40).withColumn("rank_no", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int"))
          .select(F.lit("n").alias("node"), "rank_no", F.col("id").alias("line_no")))
    got = {(r.rank_no, r.line_no) for r in L.tail_lines(df, 30).collect()}
    by_rank = {}
    for i in range(200_000):
        by_rank.setdefault(0 if i % 3 == 0 else i % 50, []).append(i)
    assert got == {(k, i) for k, v in by_rank.items() for i in v[-30:]}


def status_of(spark, rows, as_of):
    parsed = L.parse_log_lines(L.tail_lines(lines(spark, rows)), keep_bad_time=True)
    return L.suspend_seconds(L.latest_log_time(L.rank_status(parsed)), as_of)


def test_latest_time_and_silence(spark):
    head = "[a][RANK 0][2025-07-11 02:32:52][LOG_INFO] x"
    late = "[a][RANK 0][2025-07-11 02:32:40][LOG_INFO] x"
    old = "[a][RANK 0][1999-01-01 00:00:00][LOG_INFO] x"
    bad = "[a][RANK 0][2025-13-11 02:32:52][LOG_INFO] x"
    rows = [(0, 0, head), (0, 1, late), (1, 0, "no time"), (2, 0, old), (3, 0, bad)]
    got = {r.rank_no: r.suspend_seconds for r in status_of(spark, rows, "2025-07-11T02:34:52.900Z").collect()}
    # Log time beats the newer file time; the file time stands in; no entries give 0.
    assert got == {0: 120, 1: 119, 2: 119, 3: 0}
    back = {r.rank_no: r.suspend_seconds for r in status_of(spark, rows, "2025-07-11T02:32:51.100Z").collect()}
    assert back[0] == 0 and back[1] == -1


def test_no_believable_time(spark):
    df = L.latest_log_time(spark.createDataFrame(
        [("n", 0, "RANK0", 1, None, dt.datetime(1970, 1, 1, tzinfo=UTC)), ("n", 1, "RANK1", 1, None, None)],
        "node string, rank_no int, rank string, entries bigint, last_entry timestamp, file_mtime timestamp"))
    assert [r.suspend_seconds for r in L.suspend_seconds(df, "2025-01-01T00:00:00Z").collect()] == [-10, -10]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([("n", 3, "RANK3", 120), ("n", 10, "RANK10", 121), ("n", 4, "RANK4", 500), ("m", 0, "RANK0", -10)],
                               "node string, rank_no int, rank string, suspend_seconds int")
    assert [tuple(r) for r in L.suspicious_nodes(df).collect()] == [("n", "RANK4", 500)]


def test_complete_ranks(spark):
    ranges = spark.createDataFrame([("n0", 0, 4), ("n1", 5, 5)], "node string, min_rank int, max_rank int")
    status = status_of(spark, [(0, 0, "x"), (4, 0, "x")], "2025-07-11T02:34:53Z")
    files = spark.createDataFrame([("n0", 0), ("n0", 1), ("n0", 2), ("n0", 4)], "node string, rank_no int")
    failed = spark.createDataFrame([("n0", 2, "token too long")], "node string, rank_no int, reason string")
    got = {r.rank_no: (r.entries, r.suspend_seconds, r.marker) for r in L.complete_ranks(ranges, status, files, failed, inclusive=False).collect()}
    assert got == {0: (1, 120, None), 1: (0, 0, None), 2: (1, -10, "Log reading failed: token too long"),
                   3: (1, -10, "Log reading failed: no such file")}
    full = L.complete_ranks(ranges, status, files, failed, inclusive=True)
    assert {r.rank_no for r in full.collect()} == {0, 1, 2, 3, 4, 5}


def test_oversized(spark):
    df = lines(spark, [(0, 0, "x" * (1024 * 1024)), (1, 0, "x" * (1024 * 1024 - 1))])
    assert [r.rank_no for r in L.oversized_ranks(df).collect()] == [0]


def test_nested_records(spark):
    rows = [(0, 0, "b"), (0, 1, "a")]
    parsed = L.parse_log_lines(L.tail_lines(lines(spark, rows)), keep_bad_time=True)
    status = L.suspend_seconds(L.latest_log_time(L.rank_status(parsed, with_log=True)), "2025-07-11T02:34:53Z")
    got = L.merge_rank_logs(status).first()
    assert [e.message for e in got.entries] == ["b", "a"] and got.suspend_seconds == 120
    ranges = spark.createDataFrame([("n0", 0, 2)], "node string, min_rank int, max_rank int")
    absent = ["Log reading failed: no such file"]
    for inclusive, want in ((False, {0: ["b", "a"], 1: absent}), (True, {0: ["b", "a"], 1: absent, 2: absent})):
        full = L.merge_rank_logs(L.complete_ranks(ranges, status, inclusive=inclusive)).collect()
        assert {r.rank_no: [e.message for e in r.entries] for r in full} == want


def test_latest_run_dir(spark):
    rows = [("w", "w/a", dt.datetime(2025, 1, 1), True), ("w", "w/b", dt.datetime(2025, 1, 2), True),
            ("w", "w/f", dt.datetime(2025, 1, 3), False)]
    df = spark.createDataFrame(rows, "work_dir string, path string, mtime timestamp, is_dir boolean")
    assert L.latest_run_dir(df).first().path == "w/b"


def test_highest_rank(spark):
    df = spark.createDataFrame([("RANK9",), ("RANK10",), ("none",)], "rank string")
    assert L.highest_rank(df).first().rank == "RANK10"
    assert [r.rank for r in L.order_by_rank(df).collect()] == ["none", "RANK9", "RANK10"]


# --- helpers against brute force ---------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_a_join(spark, how):
    rnd = random.Random(1)
    big = spark.createDataFrame([(rnd.choice([0, 0, 0, 1, 2, None]), i) for i in range(500)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (2, "b"), (2, "c"), (7, "d")], "k int, w string")
    spread = K.spread_join(big, small, ["k"], ["v"], how)
    plain = big.join(small, ["k"], how)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_spread_join_refuses_outer(spark):
    with pytest.raises(ValueError):
        K.spread_join(spark.range(1), spark.range(1), ["id"], ["id"], "full_outer")


def test_number_alerts_with_hot_node_and_ties(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < .7 else f"n{rnd.randrange(5)}", f"e{i}", rnd.choice([10**12, 10**12 + 1, rnd.randrange(10**12, 10**12 + 10**9)]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "node string, id string, timestamp bigint")
    got = {(r.node, r.id): r.alert_no for r in E.number_alerts(df).collect()}
    want = {}
    for node in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == node), key=lambda r: (-r[2], r[1]))
        want |= {(node, r[1]): i + 1 for i, r in enumerate(ordered)}
    assert got == want


# --- processes -----------------------------------------------------------------------------

PROC = "node string, pid bigint, ppid bigint, name string, cmdline string, environ string"


def procs(spark):
    return spark.createDataFrame([
        ("n", 10, 1, "torchrun", "python -m torchrun t.py", ""),
        ("n", 20, 10, "python", "t", "RANK=4\0LOCAL_RANK=0"),
        ("n", 21, 10, "python", "t", "RANK=5\0"),
        ("n", 22, 10, "python", "t", "LOCAL_RANK=1"),
        ("n", 23, 10, "python", "t", "RANK=x"),
        ("n", 30, 20, "pt_data_worker", "t", ""), ("n", 31, 20, "pt_data_worker2", "t", ""),
        ("n", 32, 22, "pt_data_worker", "t", ""), ("m", 33, 20, "pt_data_worker", "t", ""),
        ("n", 9, 1, "x", "distributed-launch", ""), ("n", 40, 9, "python", "t", "RANK=99")], PROC)


def test_process_tree(spark):
    got = sorted(map(tuple, P.process_tree(procs(spark)).collect()), key=str)
    assert got == sorted([("n", "trainer", 20, 10, 4, 0), ("n", "trainer", 21, 10, 5, None), ("n", "trainer", 23, 10, None, None),
                          ("n", "dataloader", 30, 20, 4, 0)], key=str)


def test_rank_range_uses_the_first_launcher(spark):
    assert [tuple(r) for r in P.rank_range(procs(spark)).collect()] == [("n", 99, 99)]
    rest = procs(spark).filter("pid <> 9")
    assert [tuple(r) for r in P.rank_range(rest).collect()] == [("n", 4, 5)]


def test_filter_processes(spark):
    df = spark.createDataFrame([(1, "RANK0"), (2, "RANK0"), (1, "RANK10")], "type int, rank string")
    assert P.filter_processes(df).count() == 3
    assert P.filter_processes(df, type=1).count() == 2
    assert P.filter_processes(df, rank="rank0").count() == P.filter_processes(df, rank=0).count() == 2


# --- snapshots -----------------------------------------------------------------------------

SNAP = ("node string, snapshot_no int, snapshot_time string, pid bigint, rank string, type int, "
        "threads array<struct<thread_id:int,thread_name:string,stack_frames:array<string>>>")


def snaps(spark, rows):
    return spark.createDataFrame([("n", s, f"time{2 - s}", pid, rank, 2, [(i, "t", f) for i, f in threads])
                                  for s, pid, rank, threads in rows], SNAP)


def diffs(spark, rows):
    return [r.diff for r in S.stack_diffs(snaps(spark, rows)).orderBy("pid").collect()]


def errors(spark, rows):
    return [r.error for r in S.pair_errors(snaps(spark, rows)).collect()]


def test_thread_order_does_not_matter(spark):
    rows = [(0, 61, "", [(17, ["load batch", "all reduce"]), (29, ["all reduce", "load batch"])]),
            (1, 61, "", [(29, ["all reduce", "load batch"]), (17, ["load batch", "all reduce"])])]
    assert diffs(spark, rows) == [] and errors(spark, rows) == []


def test_first_difference_text(spark):
    head = "RANK3, Process type: PROCESS_DATA_LOADER, Process ID:7310"
    frames = [f"f{i}" for i in range(8)]
    cases = [
        ([(1, frames + ["new"])], [(1, frames + ["old"])],
         f"Detected different process stacks. {head}, Thread ID: 1, Stack frame level: 9\n"
         "[time1]Stack frame content: new\n[time2]Stack frame content: old\n"),
        ([(1, ["a"]), (2, ["x"])], [(1, ["a"]), (3, ["y"])],
         f"Detected different thread IDs. {head}\n[time1]Thread ID: 2\n[time2]Thread ID: 3\n"),
        ([(1, ["a"])], [(1, ["a", "b"])],
         f"Detected different number of thread stack frames. {head}, Thread ID: 1\n[time1]Frame count: 1\n[time2]Frame count: 2\n"),
        ([(1, ["a"])], [(1, ["a"]), (2, [])],
         f"Detected different number of threads in process stack. {head}\n[time1]Thread count: 1\n[time2]Thread count: 2\n"),
        ([(1, ["A"])], [(1, ["a"])], None),
    ]
    for now, then, want in cases:
        assert diffs(spark, [(0, 7310, "RANK3", then), (1, 7310, "RANK3", now)]) == ([want] if want else [])


def test_pair_errors(spark):
    t = [(1, ["a"])]
    assert errors(spark, [(0, 1, "RANK0", t), (1, 1, "rank0", t)]) == []
    assert errors(spark, [(0, 1, "RANK0", t), (1, 1, "RANK0", t), (1, 2, "RANK1", t)]) == ["process count mismatch: psa: 2, psb: 1"]
    assert errors(spark, [(0, 1, "RANK0", t)]) == []  # the second sample was not taken: nothing to compare
    assert errors(spark, [(0, 1, "RANK0", t), (1, 2, "RANK0", t)]) == [
        "internal error, comparing two different processes. pid: 2 and 1"]
    assert errors(spark, [(0, 1, "RANK0", t), (1, 2, "RANK1", t)]) == ["process ranks are different: RANK1 and RANK0"]


def test_all_samples_are_compared(spark):
    df = snaps(spark, [(i, 1, "RANK0", [(1, [f"frame {i}"])]) for i in range(8)])
    errs = S.pair_errors(df)
    found = S.snapshot_verdict(df, S.stack_diffs(df, errors=errs), errs)
    assert sorted((r.snapshot_no, r.verdict) for r in found.collect()) == [(i, "haveDiff") for i in range(1, 8)]


def loop_error(now, then):
    """Position by position, as a person would compare two sorted lists."""
    if len(now) != len(then):
        return f"process count mismatch: psa: {len(now)}, psb: {len(then)}"
    for (pid_a, rank_a), (pid_b, rank_b) in zip(sorted(now), sorted(then)):
        if rank_a.lower() != rank_b.lower():
            return f"process ranks are different: {rank_a} and {rank_b}"
        if pid_a != pid_b:
            return f"internal error, comparing two different processes. pid: {pid_a} and {pid_b}"
    return None


def test_pair_errors_against_a_loop(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for case in range(150):
        sides = []
        for s in (1, 0):
            size = rnd.randint(1, 4)
            sides.append([(pid, rnd.choice(["RANK0", "RANK0", "RANK1"])) for pid in rnd.sample(range(1, 7), size)])
            rows += [(f"n{case}", s, "t", pid, rank, 1, []) for pid, rank in sides[-1]]
        want[f"n{case}"] = loop_error(*sides)
    df = spark.createDataFrame(rows, SNAP)
    got = {r.node: r.error for r in S.pair_errors(df).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_verdict_and_custom_rule(spark):
    t = [(1, ["a"])]
    df = snaps(spark, [(0, 1, "RANK0", t), (1, 1, "RANK0", t), (2, 1, "RANK0", [(1, ["b"])])])
    errs = S.pair_errors(df)
    found = S.stack_diffs(df, errors=errs)
    got = {r.snapshot_no: (r.verdict, r.diffs) for r in S.snapshot_verdict(df, found, errs).collect()}
    assert got == {1: ("noDiff", 0), 2: ("haveDiff", 1)}
    rule = lambda pairs: pairs.select(F.col("now.rank").alias("rank"), F.lit("seen").alias("diff"), F.col("now.type").alias("type"))
    assert S.stack_diffs(df, rule).count() == 2


# --- events ----------------------------------------------------------------------------------

EV = ("id string, source string, type string, job_id string, message string, timestamp bigint, severity int, "
      "processed boolean, processed_at bigint, node string, path string")


def store(spark, n=400, seed=5):
    rnd = random.Random(seed)
    rows = [(f"e{i}", rnd.choice(["s", "t"]), rnd.choice(["alert", "audit"]), rnd.choice(["j1", "j2"]), f"m{i}", rnd.randrange(1000),
             rnd.randrange(4), rnd.random() < .4, 0, rnd.choice("abc"), f"f{rnd.randrange(60)}") for i in range(n)]
    return spark.createDataFrame(rows, EV), rows


@pytest.mark.parametrize("seed", range(6))
def test_pruning_never_loses_a_match(spark, seed):
    df, rows = store(spark, seed=seed)
    rnd = random.Random(seed)
    by = E.EventFilter(rnd.choice([None, 300]), rnd.choice([None, 600]), rnd.randrange(4), rnd.choice([None, "alert"]),
                       rnd.choice([None, "s"]), rnd.choice([None, "j1"]), rnd.random() < .5)
    whole = {r.id for r in E.filter_events(df, by).collect()}
    pruned = {r.id for r in E.filter_events(E.prune_event_files(df, E.event_file_index(df), by), by).collect()}
    want = {r[0] for r in rows if (by.start_ms is None or r[5] >= 300) and (by.end_ms is None or r[5] <= 600)
            and r[6] >= by.min_severity and (not by.type or r[2] == by.type) and (not by.source or r[1] == by.source)
            and (not by.job_id or r[3] == by.job_id) and not (by.unprocessed and r[7])}
    assert whole == pruned == want


def test_marks(spark):
    df = spark.createDataFrame([("a", False, 0), ("b", False, 0), ("c", True, 5)], "id string, processed boolean, processed_at bigint")
    ledger = spark.createDataFrame([("a", True, 9, 1), ("a", True, 9, 1), ("b", True, 8, 1), ("b", False, 10, 2), ("c", False, 7, 3)],
                                   "id string, processed boolean, processed_at bigint, seq bigint")
    got = {r.id: (r.processed, r.processed_at) for r in E.apply_processed(df, ledger).collect()}
    assert got == {"a": (True, 9), "b": (False, 10), "c": (False, 7)}
    assert {r.id for r in E.unprocessed(df, ledger).collect()} == {"b", "c"}
    marks = E.marks_for(df, 77, 4)
    assert {r.id for r in E.unprocessed(df, ledger.unionByName(marks).unionByName(marks)).collect()} == set()


def test_event_defaults(spark):
    df = spark.createDataFrame([("", 0, ""), ("x", 5, "audit"), (None, None, None)], "id string, timestamp bigint, type string")
    got = [tuple(r) for r in E.event_defaults(df, 99, F.lit("new")).collect()]
    assert got == [("new", 99, "alert"), ("x", 5, "audit"), ("new", 99, "alert")]
    ids = [r.id for r in E.event_defaults(df, 99).collect()]
    assert ids[0] != ids[2] and len(ids[0]) == 36


def test_poll_window(spark):
    first = E.poll_window(None, 1_000_000_000_000)
    assert first.start_ms == 946_684_800_000 and first.unprocessed and first.type == "alert"
    assert E.poll_window(first.end_ms, 2).start_ms == first.end_ms


def test_alert_messages(spark):
    nodes = spark.createDataFrame([("ok", None), ("quiet", None), ("down", "refused")], "node string, error string")
    rows = [("ok", f"e{i}", 1_700_000_000_000 + i, 3, f"say \"{i}\" <&>") for i in range(7)] + [("down", "z", 1, 0, "old")]
    alerts = spark.createDataFrame(rows, "node string, id string, timestamp bigint, severity int, message string")
    got = E.alert_messages(nodes, alerts, "2024-01-01 00:00:00", per_message=3).orderBy("node", "part").collect()
    assert [(r.node, r.part) for r in got] == [("down", 0), ("ok", 0), ("ok", 1), ("ok", 2)]
    assert got[0].text.endswith("Status: Failed\nError message: refused\n")
    head = "【Alert Notification:】\nNode: ok\nProcessing time: 2024-01-01 00:00:00\n--------------------\nStatus: Found 7 alerts\n"
    assert all(r.text.startswith(head) for r in got[1:])
    body = "".join(r.text.removeprefix(head) for r in got[1:])
    assert body.count("Level: CRITICAL") == 7 and body.startswith("1. Time: 2023-11-14 22:13:20.006\n   Level: CRITICAL\n   Message: say \"6\"")
    assert json.loads(got[1].payload) == {"msg_type": "text", "content": {"text": got[1].text}}
    rollup = {r.node: (r.alert_count, r.no_alert) for r in E.alert_rollup(nodes, alerts).collect()}
    assert rollup == {"ok": (7, False), "quiet": (0, True), "down": (0, False)}


# --- fleet -----------------------------------------------------------------------------------

def test_versions(spark):
    schema = "op string, node string, version string, error string"
    one = spark.createDataFrame([("version", "a", "1", None), ("version", "b", "2", "refused")], schema)
    assert V.version_report(one).first() == Row(versions=["1"], mismatch=False, none=False)
    two = V.union_results(one, spark.createDataFrame([("version", "c", "3")], "op string, node string, version string"))
    assert V.version_report(two).first() == Row(versions=["1", "3"], mismatch=True, none=False)
    none = one.filter("error is not null")
    assert V.version_report(none).first() == Row(versions=[], mismatch=False, none=True)
    assert tuple(V.failure_summary(two).first()) == ("version", 1, 2)
    assert V.failure_messages(two).first().message == "Node b: refused"


def test_histogram(spark):
    df = spark.createDataFrame([("m", None, .005), ("m", "x", .3), ("m", None, 11.0)], "method string, error string, duration double")
    got = {r.le: r.requests for r in V.latency_histogram(df).collect()}
    assert got["0.005"] == 1 and got["0.25"] == 1 and got["0.5"] == 2 and got["10"] == 2 and got["+Inf"] == 3
    totals = {(r.method, r.status): r.requests for r in V.request_totals(df).collect()}
    assert totals == {("m", "success"): 2, ("m", "error"): 1}
