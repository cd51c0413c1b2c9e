"""The stored index against plain filters, ranking by ranges, and the ledger."""

import random

import pytest
from pyspark.sql import functions as F

from trainscope.operators import events as E
from trainscope.operators.skew import number_by_ranges
from trainscope.session import work_path
from trainscope.sinks import tables as K
from trainscope.sinks.event_index import read_event_index, read_matching_events, update_event_index
from trainscope.sources.events import read_event_store
from trainscope.streaming import ledger as G

from .test_streaming import EVENTS, files

DAY = 86_400_000
STORE = "id string, source string, type string, job_id string, message string, timestamp bigint, severity int, processed boolean, processed_at bigint"


def lot(spark, seed, n=400):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"{seed}-{i}", rng.choice("st"), rng.choice(["alert", "audit"]), "j", "m", rng.randrange(20 * DAY), rng.randrange(4),
                                   rng.random() < 0.3, 0) for i in range(n)], STORE)


def test_indexed_reads_find_what_filters_find(spark):
    store, index, rng = work_path(spark, "store"), work_path(spark, "index"), random.Random(1)
    assert read_event_index(spark, index).count() == 0
    for seed in range(3):
        K.append_events(lot(spark, seed), store, 40)
        assert update_event_index(spark, store, index) > 0 and update_event_index(spark, store, index) == 0
    K.append_events(lot(spark, 3), store, 40)  # not indexed by hand: a read does it
    files_in_store = len(spark.read.parquet(store).inputFiles())
    for _ in range(6):
        start = rng.randrange(20 * DAY)
        by = E.EventFilter(start, start + rng.randrange(3 * DAY), rng.randrange(4), rng.choice([None, "alert"]), rng.choice([None, "s"]), None, rng.random() < 0.5)
        got, want = read_matching_events(spark, store, index, by), E.filter_events(read_event_store(spark, store), by)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
        assert len(got.inputFiles()) < files_in_store / 2  # the plan leaves the other files out
    assert read_event_index(spark, index).agg(F.sum("rows")).first()[0] == 1600
    assert read_matching_events(spark, store, index, E.EventFilter(start_ms=99 * DAY)).count() == 0


@pytest.mark.parametrize("parts", ["3", "64"])
def test_numbers_within_a_hot_millisecond(spark, parts):
    """A node with most rows, all of one time and with one prefix, is numbered over several ranges."""
    rng = random.Random(4)
    rows = [("hot", 5000, f"same-prefix-{i:05d}") for i in range(3000)] + [(rng.choice("abc"), rng.randrange(9), f"x{i}") for i in range(500)] + [(None, 1, "y")]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "node string, timestamp bigint, id string").repartition(5)
        numbered = E.number_alerts(df)
        got = {(r.node, r.id): r.alert_no for r in numbered.collect()}
        ranges = number_by_ranges(df.filter("node = 'hot'"), ["node"], [F.col("id").asc()], "n").select("id", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for node in ("hot", "a", "b", "c"):
        ordered = sorted((-t, i) for n, t, i in rows if n == node)
        assert [got[node, i] for _, i in ordered] == list(range(1, len(ordered) + 1))
    assert len(got) == 3500 and sorted((r.id, r.n) for r in ranges) == [(f"same-prefix-{i:05d}", i + 1) for i in range(3000)]


def event(name, at=1000, severity=2, kind="alert", processed=False):
    return (name, "s", kind, "j", at, severity, processed)


def deliver(spark, source, ledger, stream, told, loose=2, severity=0, checkpoint=None):
    def keep(alerts, batch):
        told[stream, batch] = sorted(r.id for r in alerts.collect())
    (G.deliver_alerts(source, ledger, checkpoint or work_path(spark, "cp"), stream, 50, keep, severity, loose)
     .trigger(availableNow=True).start().awaitTermination())


def test_alerts_are_told_once_over_batches_streams_and_merges(spark, tmp_path):
    ledger, told = work_path(spark, "ledger"), {}
    batches = [[event("e1", 9 * DAY), event("e1", 9 * DAY)], [event("e2"), event("e1")], [event("e3", DAY), event("a", kind="audit")],
               [event("e2"), event("e4", processed=True), event(None)], [event("e5", 0)], [event("e1"), event("e6")]]
    deliver(spark, files(spark, tmp_path / "one", batches, EVENTS), ledger, "one", told)
    assert [told["one", b] for b in range(6)] == [["e1"], ["e2"], ["e3"], [], ["e5"], ["e6"]]
    manifest = G.Manifest(spark, ledger)
    assert manifest.version >= 0 and manifest.up_to["one"] >= 3 and len(manifest.runs) <= 2
    deliver(spark, files(spark, tmp_path / "two", [[event("e1"), event("e7")], [event("e3"), event("e8", 2)]], EVENTS), ledger, "two", told)
    assert told["two", 0] == ["e7"] and told["two", 1] == ["e8"]
    marks = {r.id: (r._processed, r._processed_at) for r in E.latest_marks(G.read_ledger(spark, ledger)).collect()}
    assert marks == {f"e{i}": (True, 50) for i in (1, 2, 3, 5, 6, 7, 8)}


def test_merging_keeps_marks_and_deletes_folders(spark):
    ledger, schema = work_path(spark, "ledger"), "id string, processed boolean, processed_at bigint, seq bigint"
    want = {}
    for batch in range(40):
        rows = [(f"i{(batch * 7 + k) % 60}", (batch + k) % 5 > 0, batch, batch) for k in range(9)]
        want |= {i: (p, at) for i, p, at, _ in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{ledger}/marks/stream_id=7/batch_id={batch}")
        G.merge_marks(spark, ledger, {"7": batch}, 4)
    manifest = G.Manifest(spark, ledger)
    assert 1 <= len(manifest.runs) <= 4 and manifest.up_to["7"] >= 35
    for _ in range(2):
        got = {r.id: (r._processed, r._processed_at) for r in E.latest_marks(G.read_ledger(spark, ledger)).collect()}
        assert got == want
        assert G.drop_merged(spark, ledger) >= 0
    assert G.drop_merged(spark, ledger) == 0


def test_a_batch_that_runs_again_tells_the_same(spark, tmp_path):
    """A new checkpoint under the same stream id runs every batch again, as after a failure before its commit."""
    ledger, told, again = work_path(spark, "ledger"), {}, {}
    source = files(spark, tmp_path, [[event("e1"), event("e2")]], EVENTS)
    deliver(spark, source, ledger, "s", told)
    deliver(spark, source, ledger, "s", again)
    assert told == again == {("s", 0): ["e1", "e2"]}
