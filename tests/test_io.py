import json
import os

import pytest
from pyspark.sql import functions as F

from trainscope.operators import events as E
from trainscope.operators import logs as L
from trainscope.operators import snapshots as S
from trainscope.plans.hang_check import hang_check
from trainscope.plans.reports import log_report, stack_report
from trainscope.sinks import tables as K
from trainscope.sources import events as RE
from trainscope.sources import logs as RL
from trainscope.sources import snapshots as RS
from tests.test_functions import DUMP
from tests.test_operators import procs


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize("split", ["134217728", "4096"])
def test_rank_logs_in_file_order_however_split(spark, tmp_path, split):
    base = str(tmp_path / "run")
    write(f"{base}/rank3.log", "".join(f"Line {i}\r\n" for i in range(5000)))
    write(f"{base}/sub/rank12.log", "one\ntwo")
    write(f"{base}/rank4.log", "")
    write(f"{base}/rankx.log", "no")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = RL.read_rank_logs(spark, base, "n")
        got = [r.line for r in L.tail_lines(df, 10).filter("rank = 'RANK3'").orderBy("line_no").collect()]
        assert got == [f"Line {i}" for i in range(4990, 5000)]
        assert {(r.rank, r.line) for r in df.filter("rank_no = 12").collect()} == {("RANK12", "one"), ("RANK12", "two")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.rank_no for r in RL.list_rank_files(spark, base).collect()} == {3, 4, 12}
    assert {r.rank_no for r in RL.read_rank_logs(spark, base, rank=12).select("rank_no").collect()} == {12}
    dirs = RL.list_run_dirs(spark, base)
    assert L.latest_run_dir(dirs).first().path.startswith("file:")


def test_invalid_bytes_survive_to_the_cleaner(spark, tmp_path):
    write(str(tmp_path / "rank0.log"), b"\xef\xbb\xbfok\xff\n")
    entries = L.clean_messages(L.parse_log_lines(RL.read_rank_logs(spark, str(tmp_path), "n")))
    assert entries.first().message == "ok�"


def test_node_list(spark, tmp_path):
    write(str(tmp_path / "nodes"), " a \n\n\tb\n")
    assert [r.node for r in RL.read_node_list(spark, str(tmp_path / "nodes")).collect()] == ["a", "b"]
    write(str(tmp_path / "none"), "\n \n")
    with pytest.raises(ValueError):
        RL.read_node_list(spark, str(tmp_path / "none"))


def test_event_files(spark, tmp_path):
    event = {"id": "a", "source": "s", "type": "alert", "job_id": "j", "message": "m", "timestamp": 5, "severity": 2,
             "metadata": {"k": [1, {"z": "y"}]}, "processed": False, "processed_at": 0}
    write(str(tmp_path / "rank3_events_20240101_ab.json"), json.dumps({"events": [event, {"id": "b"}]}, indent=2))
    write(str(tmp_path / "rank3_events_20240102_ab.json"), '{"events": [')
    write(str(tmp_path / "rank4_events_20240102_ab.json"), '{"events": []}')
    write(str(tmp_path / "other.json"), json.dumps({"events": [event]}))
    df = RE.read_event_files(spark, str(tmp_path), 3)
    got = {r.id: r for r in df.withColumn("k", F.try_variant_get("metadata", "$.k[1].z", "string")).drop("metadata").collect()}
    assert got["a"].k == "y" and got["a"].severity == 2 and got["b"].message == "" and got["b"].processed is False
    assert df.count() == 2 and RE.read_event_files(spark, str(tmp_path)).count() == 2
    write(str(tmp_path / "rank5_events_20240103_ab.json"), json.dumps({"events": [{**event, "timestamp": "soon"}]}))
    bad = RE.rejected_event_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.path[-16:] for r in bad] == ["20240102_ab.json", "20240103_ab.json"]
    assert RE.read_event_files(spark, str(tmp_path)).count() == 2


def test_event_store_round_trip(spark, tmp_path):
    base = str(tmp_path / "files")
    rows = [{"id": f"e{i}", "source": "s", "type": "alert", "message": "m", "timestamp": i * 3_600_000, "metadata": {"n": i}}
            for i in range(100)]
    write(f"{base}/rank_events_1.json", json.dumps({"events": rows}))
    events = RE.read_event_files(spark, base, "")
    path = str(tmp_path / "store")
    K.append_events(events.drop("path"), path)
    K.append_events(events.drop("path").withColumn("id", F.concat("id", F.lit("x"))), path)
    store = RE.read_event_store(spark, path)
    by = E.EventFilter(30 * 3_600_000, 50 * 3_600_000, type="alert")
    found = E.filter_events(store, by)
    assert found.count() == 42
    assert {r.n for r in found.select(F.variant_get("metadata", "$.n", "int").alias("n")).collect()} == set(range(30, 51))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(timestamp" in plan


SNAPSHOT = {"pid": 7310, "ppid": 7300, "type": 2, "rank": "RANK3", "local_rank": "RANK1",
            "threads": [{"thread_id": 7310, "thread_name": "feeder", "stack_frames": ["a", "File 71\nqueue.get()"]}]}


def test_snapshots_are_numbered_over_the_files_of_a_node(spark, tmp_path):
    folder = tmp_path / "taken"
    folder.mkdir()
    for second, pid in ((30, 7), (10, 7), (20, 7)):
        (folder / f"nodegpu-a_processInfo_2025-01-31_10-00-{second}_noDiff.json").write_text(f'{{"processes":[{{"pid":{pid},"threads":[]}}]}}')
    got = RS.read_process_snapshots(spark, str(folder)).orderBy("snapshot_no").collect()
    assert [(r.node, r.snapshot_no, r.snapshot_time) for r in got] == [
        ("gpu-a", i, f"2025-01-31 10:00:{10 * (i + 1)}") for i in range(3)]


def test_snapshots_in_both_spellings(spark, tmp_path):
    moved = json.loads(json.dumps(SNAPSHOT).replace("File 71", "File 72"))
    write(str(tmp_path / "a.json"), json.dumps([[SNAPSHOT], [moved]], indent=2))
    camel = {"processes": [{"pid": 1, "type": "PROCESS_TRAINER", "rank": "RANK0", "localRank": "RANK1",
                            "threads": [{"threadId": 5, "threadName": "m}\n{", "stackFrames": ["x"]}, {}]}], "totalCount": 1}
    text = json.dumps(camel, indent=1)
    write(str(tmp_path / "node10.0.0.1_processInfo_2024-01-01_00-00-00.json"), text + "\n\n" + text + "\n\n")
    write(str(tmp_path / "b.json"), "\n" + text + "\n" + text)
    got = RS.read_process_snapshots(spark, str(tmp_path))
    files = {}
    for r in got.collect():
        files.setdefault(os.path.basename(r.path), []).append(r)
    assert {r.snapshot_no: r.threads[0].stack_frames[1] for r in files["a.json"]} == {
        0: "File 71\nqueue.get()", 1: "File 72\nqueue.get()"}
    named = next(v for k, v in files.items() if k.startswith("node10"))
    assert len(named) == 2 and named[0].node == "10.0.0.1" and {r.snapshot_no for r in named} == {0, 1}
    assert len(files["b.json"]) == 2
    one = named[0]
    assert (one.type, one.local_rank, one.ppid) == (1, "RANK1", 0)
    assert [(t.thread_id, t.thread_name, t.stack_frames) for t in one.threads] == [(5, "m}\n{", ["x"]), (0, "", [])]
    pair = got.filter("path like '%/a.json'").withColumn("node", F.lit("n")).withColumn(
        "snapshot_time", F.concat(F.lit("time"), 2 - F.col("snapshot_no")))
    diff = S.stack_diffs(pair).first().diff
    assert diff == ("Detected different process stacks. RANK3, Process type: PROCESS_DATA_LOADER, Process ID:7310, "
                    "Thread ID: 7310, Stack frame level: 2\n[time1]Stack frame content: File 72\nqueue.get()\n"
                    "[time2]Stack frame content: File 71\nqueue.get()\n")


def test_hang_check_writes_reports(spark, tmp_path):
    run = str(tmp_path / "run")
    write(f"{run}/rank0.log", "[t][RANK 0][2025-07-11 02:00:00][LOG_INFO] [Train] (Epoch 3) go\nplain\n")
    write(f"{run}/rank1.log", "[t][RANK 1][2025-07-11 02:59:00][LOG_INFO] go\n")
    lines = RL.read_rank_logs(spark, run, "n")
    ranges = spark.createDataFrame([("n", 0, 2)], "node string, min_rank int, max_rank int")
    write(str(tmp_path / "snap.json"), json.dumps([[SNAPSHOT], [SNAPSHOT], [dict(SNAPSHOT, rank="RANK8")]]))
    snaps = RS.read_process_snapshots(spark, str(tmp_path / "snap.json")).withColumn("node", F.lit("n")).withColumn("snapshot_time", F.lit("t"))
    report = hang_check(lines, snaps, "2025-07-11T03:00:00Z", ranges)
    assert [tuple(r) for r in report.nodes.collect()] == [("n", "RANK0", 3600)]
    verdicts = {r.snapshot_no: (r.verdict, r.error) for r in report.verdicts.collect()}
    assert verdicts == {1: ("noDiff", None), 2: ("haveDiff", "process ranks are different: RANK8 and RANK3")}
    out = str(tmp_path / "saved")
    K.write_process_snapshots(snaps, report.verdicts, out)
    saved = spark.read.json(out)
    assert {(r.verdict, r.total_count) for r in saved.collect()} == {("first", 1), ("noDiff", 1), ("haveDiff", 1)}

    logs_out = str(tmp_path / "logs")
    K.write_rank_logs(log_report(lines, "2025-07-11T03:00:00Z"), logs_out, "job")
    records = {r["rank"]: r for r in (json.loads(t.value) for t in spark.read.text(logs_out).collect())}
    assert records["RANK0"] == {
        "rank": "RANK0", "suspend_seconds": 3600, "tail_time": "2025-07-11T03:00:00Z", "entries": [
            {"timestamp": "2025-07-11T02:00:00Z", "level": 2, "epoch": 3,
             "Message": "[t][RANK 0][2025-07-11 02:00:00][LOG_INFO] [Train] (Epoch 3) go"},
            {"timestamp": "", "Message": "plain"}]}
    assert os.path.isdir(f"{logs_out}/job=job/selection=allrank")
    below_top = ranges.withColumn("max_rank", F.lit(0))
    one = log_report(lines, "2025-07-11T03:00:00Z", rank="RANK1", ranges=below_top)
    assert [(r["rank"], len(r.entries)) for r in one.collect()] == []
    one = log_report(lines, "2025-07-11T03:00:00Z", rank="RANK1")
    assert [(r["rank"], len(r.entries)) for r in one.collect()] == [("RANK1", 1)]


def test_stack_report(spark):
    dumps = spark.createDataFrame([("n", 20, DUMP), ("n", 30, DUMP), ("m", 20, DUMP)], "node string, pid bigint, dump string")
    got = stack_report(procs(spark), dumps, rank=4).orderBy("pid").collect()
    assert [(r.pid, r.type, r.rank, len(r.threads)) for r in got] == [(20, 1, "RANK4", 2), (30, 2, "RANK4", 2)]


def test_message_sink(spark, tmp_path):
    nodes = spark.createDataFrame([("down", "refused")], "node string, error string")
    alerts = spark.createDataFrame([], "node string, id string, timestamp bigint, severity int, message string")
    K.write_alert_messages(E.alert_messages(nodes, alerts, "now"), str(tmp_path / "m"))
    text = json.loads(spark.read.text(str(tmp_path / "m")).first().value)["content"]["text"]
    assert text.endswith("Error message: refused\n")
