import datetime as dt

from pyspark.sql import functions as F

from trainscope.operators import events as E
from trainscope.session import work_path
from trainscope.sources.events import read_event_store
from trainscope.streaming import alerts as SA
from trainscope.streaming.hang import stream_hang_detection
from trainscope.streaming.metrics import running_totals, stream_request_metrics

LINES = "node string, rank string, line string"


def drain(df, spark, name):
    out = work_path(spark, name)
    (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, name + "-cp"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(out)


def files(spark, tmp_path, batches, schema):
    """One file per batch, read one per trigger in order of writing."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def said(rank, second):
    at = dt.datetime(2025, 1, 1) + dt.timedelta(seconds=second)
    return ("n", rank, f"[t][RANK 0][{at:%Y-%m-%d %H:%M:%S}][LOG_INFO] x")


def test_hang_stream(spark, tmp_path):
    # a pauses for exactly the limit, b for one second more, c stops.
    batches = [[said("a", 0), said("b", 0), said("c", 0), ("n", "a", "noise")], [said("a", 120), said("b", 121)],
               [said("a", 200), said("b", 200)], [said("a", 300), said("b", 300)]]
    found = drain(stream_hang_detection(files(spark, tmp_path, batches, LINES), "0 seconds"), spark, "hang")
    start = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    got = {(r.rank, r.at - start, r.lines) for r in found.select("rank", F.unix_seconds("last_line").alias("at"), "lines").collect()}
    assert got == {("b", 0, 1), ("c", 0, 1)}


def test_hang_stream_with_heartbeat(spark, tmp_path):
    lines = files(spark, tmp_path, [[said("a", 0)]], LINES)
    beats = files(spark, tmp_path / "beat", [[(dt.datetime(2025, 1, 1, 0, 0, 10),)], [(dt.datetime(2025, 1, 1, 1),)]], "ts timestamp")
    found = drain(stream_hang_detection(lines, "0 seconds", heartbeat=beats), spark, "beat").collect()
    assert [(r.rank, r.lines) for r in found] == [("a", 1)]


EVENTS = "id string, source string, type string, job_id string, timestamp bigint, severity int, processed boolean"


def test_alert_stream_delivers_once(spark, tmp_path):
    one = ("e1", "s", "alert", "j", 1000, 2, False)
    batches = [[one, ("e2", "s", "audit", "j", 1000, 2, False)], [one, ("e3", "s", "alert", "j", 2000, 0, False)],
               [("e4", "s", "alert", "j", 3000, 3, False), ("e5", "s", "alert", "j", 3000, 3, True)]]
    source = files(spark, tmp_path, batches, EVENTS)
    assert sorted(r.id for r in drain(SA.stream_alerts(source, 1), spark, "alerts").collect()) == ["e1", "e4"]


def test_marks_are_the_same_when_a_batch_runs_again(spark, tmp_path):
    source = files(spark, tmp_path, [[("e1", "s", "alert", "j", 1000, 2, False)], [("e2", "s", "alert", "j", 2000, 2, False)]], EVENTS)
    ledger = work_path(spark, "ledger")
    for _ in range(2):  # A fresh checkpoint makes every batch run again.
        (SA.write_marks(SA.stream_alerts(source), ledger, work_path(spark, "cp"), 50, "a")
         .trigger(availableNow=True).start().awaitTermination())
    marks = spark.read.parquet(ledger)
    assert sorted((r.id, r.processed, r.processed_at, r.seq) for r in marks.collect()) == [("e1", True, 50, 0), ("e2", True, 50, 1)]
    events = spark.createDataFrame([("e1", False, 0), ("e9", False, 0)], "id string, processed boolean, processed_at bigint")
    assert [r.id for r in E.unprocessed(events, marks).collect()] == ["e9"]


def test_two_streams_keep_both_marks(spark, tmp_path):
    ledger = work_path(spark, "ledger")
    for name in ("e1", "e2"):
        source = files(spark, tmp_path / name, [[(name, "s", "alert", "j", 1000, 2, False)]], EVENTS)
        (SA.write_marks(SA.stream_alerts(source), ledger, work_path(spark, "cp"), 50, name)
         .trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.id for r in spark.read.parquet(ledger).collect()) == ["e1", "e2"]


def test_an_alert_a_day_late_is_delivered(spark, tmp_path):
    day = 86_400_000
    batches = [[(name, "s", "alert", "j", at, 2, False)] for name, at in (("e1", 9 * day), ("e2", 9 * day + 1), ("e3", 8 * day), ("e4", day))]
    found = drain(SA.stream_alerts(files(spark, tmp_path, batches, EVENTS)), spark, "late").collect()
    assert sorted(r.id for r in found) == ["e1", "e2", "e3", "e4"]


def test_ingest_ids_do_not_change(spark, tmp_path):
    good = '{"msg_type":"text","content":{"text":"hi"}}'
    source = files(spark, tmp_path, [[(1, good), (2, "{")], [(3, good)]], "offset bigint, body string")
    seen = []
    for _ in range(2):
        events, out = SA.stream_event_ingest(source, "body", 86_400_000, ["offset"]), work_path(spark, "ingest")
        SA.write_event_stream(events, out, work_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
        rows = read_event_store(spark, out).collect()
        assert [(r.message, r.source, str(r.event_date)) for r in rows] == [("hi", "trainning", "1970-01-02")] * 2
        seen.append({r.id for r in rows})
    assert seen[0] == seen[1] and len(seen[0]) == 2


def test_metrics_stream(spark, tmp_path):
    t = lambda s: dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    batches = [[("m", None, t(1)), ("m", None, t(14)), ("m", "x", t(2))], [("m", None, t(16))], [("m", None, t(500))]]
    source = files(spark, tmp_path, batches, "method string, error string, ts timestamp")
    found = running_totals(drain(stream_request_metrics(source, "1 minute"), spark, "metrics"))
    got = sorted((r.status, r.requests, r.total) for r in found.collect())
    assert got == [("error", 1, 1), ("success", 1, 3), ("success", 2, 2)]


def test_last_windows_come_with_a_closing_beat(spark, tmp_path):
    t = lambda s: dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    source = files(spark, tmp_path, [[("m", None, t(i * 15))] for i in range(4)], "method string, error string, ts timestamp")
    # The beat runs with the requests: one that is ahead makes them late.
    beat = files(spark, tmp_path / "beat", [[(t(0),)]] * 3 + [[(t(9999),)]], "ts timestamp")
    found = running_totals(drain(stream_request_metrics(source, "0 seconds", heartbeat=beat), spark, "metrics"))
    assert sorted((r.requests, r.total) for r in found.collect()) == [(1, i + 1) for i in range(4)]


def test_totals_over_many_blocks(spark, monkeypatch):
    from trainscope.streaming import metrics
    monkeypatch.setattr(metrics, "BLOCK", 3)
    rows = spark.range(50).selectExpr("timestamp_seconds(id * 15) AS start", "timestamp_seconds(id * 15 + 15) AS end", "'m' AS method",
                                      "if(id % 2 = 0, 'success', 'error') AS status", "id AS requests")
    got = {(r.status, r.requests): r.total for r in running_totals(rows).collect()}
    assert got == {("error" if i % 2 else "success", i): sum(range(i % 2, i + 1, 2)) for i in range(50)}


def test_ingest_keeps_rejects_and_arrival_times(spark, tmp_path):
    good, late = '{"MSG_TYPE":"text","content":{"Text":"one"}}', '{"content":{"text":"a \\"Content\\": b"},"content":{"text":"last"}}'
    source = files(spark, tmp_path, [[(1, good, 5), (2, "{", 6)], [(3, late, 86_400_007), (4, '{"content":7}', 8)]], "offset bigint, body string, at bigint")
    for _ in range(2):  # a fresh checkpoint runs every batch again, into the same folders
        store, rejects = str(tmp_path / "store"), str(tmp_path / "rejects")
        (SA.write_ingest(source, "body", ["offset"], F.col("at"), store, rejects, work_path(spark, "cp"))
         .trigger(availableNow=True).start().awaitTermination())
    assert sorted((r.message, r.timestamp, str(r.event_date)) for r in read_event_store(spark, store).collect()) == [
        ("last", 86_400_007, "1970-01-02"), ("one", 5, "1970-01-01")]
    assert sorted((r.payload, r.timestamp) for r in spark.read.parquet(rejects).collect()) == [("{", 6), ('{"content":7}', 8)]
