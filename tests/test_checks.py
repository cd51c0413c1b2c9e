"""Saved checks of process stacks: documents, samples, rejects, and what is compared with what."""

import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from trainscope import fixtures as X
from trainscope.operators import snapshots as S
from trainscope.plans.catalog import QUERIES
from trainscope.session import _own_dir, passing, stored, work_path
from trainscope.sinks import tables as K
from trainscope.sources import snapshots as R
from trainscope.sources.snapshots import read_snapshots


def process(pid, *frames, rank="RANK0"):
    return {"pid": pid, "type": "PROCESS_TRAINER", "rank": rank, "localRank": rank,
            "threads": [{"threadId": 5, "threadName": "main", "stackFrames": list(frames)}]}


def sample(*processes):
    return json.dumps({"processes": list(processes), "totalCount": len(processes)} if processes else {}, indent=1) + "\n\n"


def save(folder, node, clock, text, suffix="_noDiff"):
    folder.mkdir(exist_ok=True)
    with open(folder / f"node{node}_processInfo_2025-02-03_{clock}{suffix}.json", "a", encoding="utf-8") as out:
        out.write(text)


def verdicts(tables):
    found = S.sample_verdicts(tables.processes, tables.samples).collect()
    return {(r.node, r.check_id[11:], r.snapshot_no): (r.verdict, r.diffs, r.error) for r in found}


def test_checks_are_kept_apart(spark, tmp_path):
    """Two checks an hour apart, nothing moving inside either, are both without a difference."""
    for hour in (10, 11):
        for s in range(3):
            save(tmp_path / "a", "n1", f"{hour}-00-{5 * s:02d}", sample(process(1, f"at {hour}"), process(2, "wait")), "" if s == 0 else "_noDiff")
    tables = read_snapshots(spark, str(tmp_path / "a"))
    assert verdicts(tables) == {("n1", f"{h}:00:00", s): ("noDiff", 0, None) for h in (10, 11) for s in (1, 2)}
    assert sorted((r.check_id[11:], r.snapshot_no, r.n_processes) for r in tables.samples.collect()) == [
        (f"{h}:00:00", s, 2) for h in (10, 11) for s in range(3)]


def test_beginnings_by_name_and_by_pause(spark, tmp_path):
    folder = tmp_path / "a"
    for clock, suffix in (("23-59-50", ""), ("23-59-55", "_haveDiff"), ("23-59-58", ""), ("23-59-59", "_noDiff")):
        save(folder, "x", clock, sample(process(1, clock)), suffix)
    for clock in ("00-00-10", "00-00-59", "00-01-50"):  # over midnight: 11, 49 and 51 seconds
        folder.joinpath(f"nodex_processInfo_2025-02-04_{clock}_noDiff.json").write_text(sample(process(1, clock)))
    got = [(r.check_id[8:], r.snapshot_no) for r in read_snapshots(spark, str(folder)).samples.orderBy("snapshot_time").collect()]
    assert got == [("03 23:59:50", 0), ("03 23:59:50", 1), ("03 23:59:58", 0), ("03 23:59:58", 1), ("03 23:59:58", 2), ("03 23:59:58", 3), ("04 00:01:50", 0)]


def test_empty_samples_are_facts_and_broken_ones_rejects(spark, tmp_path):
    folder, whole = tmp_path / "a", sample(process(1, "x"))
    save(folder, "n", "10-00-00", whole, "")
    save(folder, "n", "10-00-05", sample())
    save(folder, "n", "10-00-10", whole)
    save(folder, "m", "10-00-00", whole, "")
    save(folder, "m", "10-00-05", whole[:-20] + "\n\n")
    save(folder, "m", "10-00-06", sample(dict(process(1), pid="one")))
    tables = read_snapshots(spark, str(folder))
    assert verdicts(tables) == {
        ("n", "10:00:00", 1): ("haveDiff", 0, "process count mismatch: psa: 0, psb: 1"),
        ("n", "10:00:00", 2): ("haveDiff", 0, "process count mismatch: psa: 1, psb: 0")}
    assert sorted((r.node, r.snapshot_time[14:]) for r in tables.rejects.collect()) == [("m", "00:05"), ("m", "00:06")]
    assert tables.samples.filter("node = 'm'").count() == 1


def test_documents_one_after_the_other_in_a_file(spark, tmp_path):
    """A long file is cut at blank lines and read in several parts, in order."""
    folder = tmp_path / "a"
    save(folder, "n", "10-00-00", "".join(sample(process(1, f"frame {i}" * 40)) for i in range(60)), "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        tables = read_snapshots(spark, str(folder))
        got = [r.threads[0].stack_frames[0] for r in tables.processes.orderBy("snapshot_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"frame {i}" * 40 for i in range(60)] and tables.samples.select("check_id").distinct().count() == 1


def test_sink_and_reader_agree(spark, tmp_path):
    folder = tmp_path / "a"
    for s, text in enumerate((sample(process(1, "x"), process(2, "y")), sample(), sample(process(1, "x", rank="RANK0"), process(2, "z")))):
        save(folder, "10.0.0.1", f"10-00-{5 * s:02d}", text, "" if s == 0 else "_noDiff")
    save(folder, "b+c d", "11-00-00", sample(process(9, 'q"uote\n\nline')), "")
    tables = read_snapshots(spark, str(folder))
    out = str(tmp_path / "saved")
    K.write_process_snapshots(tables.processes, S.sample_verdicts(tables.processes, tables.samples), out, tables.samples)
    again = read_snapshots(spark, out)
    for one, two, drop in ((tables.processes, again.processes, ["path"]), (tables.samples, again.samples, ["path"])):
        rows = [sorted(map(str, x.drop(*drop).collect())) for x in (one, two)]
        assert rows[0] == rows[1] and rows[0]
    assert verdicts(tables) == verdicts(again) and again.rejects.count() == 0


def test_no_files_and_no_processes(spark, tmp_path):
    save(tmp_path / "a", "n", "10-00-00", "\n\n", "")
    tables = read_snapshots(spark, str(tmp_path / "a"))
    assert tables.processes.count() == tables.samples.count() == tables.rejects.count() == 0 and verdicts(tables) == {}


def test_only_moved_stacks_are_fetched(spark, tmp_path):
    folder = tmp_path / "a"
    for s in range(3):
        save(folder, "n", f"10-00-{5 * s:02d}", sample(*(process(p, f"Frame {s if p % 50 == 7 else 0}" if s % 2 else f"frame {s if p % 50 == 7 else 0}")
                                                         for p in range(200))), "" if s == 0 else "_noDiff")
    tables = read_snapshots(spark, str(folder))
    compared = S.compare_samples(tables.processes, tables.samples)
    assert sorted({r.pid for r in compared.moved.collect()}) == [7, 57, 107, 157] and S.moved_pairs(tables.processes, compared).count() == 8
    assert {r.pid for r in S.stack_diffs(tables.processes, compared=compared).collect()} == {7, 57, 107, 157}


def test_long_documents_are_read_in_pieces(spark, tmp_path):
    """A document longer than a row may be gives rows of some of its processes; a bad one is a reject as a whole."""
    folder, many = tmp_path / "a", [process(i, f"a {{[,]}} \"q\" {i}" * 6) for i in range(30_000)]
    whole = sample(*many)
    save(folder, "n", "10-00-00", whole, "")
    save(folder, "n", "10-00-05", sample(process(1, "x")) + "\n" + json.dumps([many, [], [process(2, "y")]]) + "\n" + sample(process(3, "z")))
    save(folder, "m", "10-00-00", whole[:-9], "")
    save(folder, "m", "10-00-05", whole.replace('"pid": 20000', '"pid": "one"'))
    tables = read_snapshots(spark, str(folder))
    assert R._documents(R._files(spark, str(folder))).agg(F.max(F.octet_length("text"))).first()[0] <= 2 * R.READ < len(whole)
    assert sorted((r.node, r.snapshot_no, r.n_processes) for r in tables.samples.collect()) == [
        ("n", 0, 30_000), ("n", 1, 1), ("n", 2, 30_000), ("n", 3, 0), ("n", 4, 1), ("n", 5, 1)]
    got = tables.processes.groupBy("snapshot_no").agg(F.count_distinct("pid"), F.count_distinct(F.col("threads")[0].stack_frames[0]))
    assert sorted(map(tuple, got.collect())) == [(0, 30_000, 30_000), (1, 1, 1), (2, 30_000, 30_000), (4, 1, 1), (5, 1, 1)]
    texts = {}
    for r in tables.rejects.orderBy("part").collect():
        texts[r.snapshot_time] = texts.get(r.snapshot_time, "") + r.content
    bad = (whole[:-9], whole.replace('"pid": 20000', '"pid": "one"'))
    assert [texts[t].strip() for t in sorted(texts)] == [x.strip() for x in bad]


def test_pieces_do_not_depend_on_ranges(monkeypatch):
    """Each document comes once, whichever ranges and reads cut the file."""
    monkeypatch.setattr(R, "PART", 40)
    monkeypatch.setattr(R, "READ", 64)
    docs = [json.dumps({"processes": [{"pid": i, "x": "]},{[\\\"" * (i % 3)} for i in range(n)], "totalCount": n}, indent=1 if n == 5 else None) for n in (0, 1, 9, 5, 30)]
    docs += [json.dumps([[{"pid": 1}, {"pid": 2}] * 4, [], [{"pid": 3}] * 9]), '{"processes":[{"pid":1},' + '{"pid":2},' * 9 + "]}", '{"a":"' + "b" * 200]
    for gaps in (["\n\n"] * 8, ["\n\n\n"] * 8, ["\n"] * 5 + ["\n\n"] * 3):
        text = "".join(d + g for d, g in zip(docs, gaps)).encode()
        for size in (1, 7, 50, 333, 5000):
            got, lists = [], 0
            for start in range(0, len(text), size):
                for row, fresh, part, base, opening, closing, piece in R._read_range(io.BytesIO(text), start, min(start + size, len(text))):
                    if part < 0:
                        got += [x.strip() for x in R._BREAK.split(piece) if x.strip()]
                    elif part == 0:
                        got.append(piece.strip())
                    else:
                        got[-1] += piece.rstrip() if not closing else piece
                    if part >= 0 and got[-1].startswith((docs[2][:40].encode(), b"[[")):
                        json.loads(opening + (piece.decode().strip()[:-1] if closing else piece.decode()) + closing)
            assert [x.decode().strip() for x in got] == docs, (gaps[0], size)


def test_tasks_follow_the_rows_that_are_dealt(spark, monkeypatch):
    """What one task makes, sorts and sends stays the same as the source table grows."""
    monkeypatch.setattr(X, "DEALT", 100)
    sizes = X.dealt(spark.range(2000), "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 200
    assert X.dealt(spark.range(5), "id").count() == 5


def files_below(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_"))]


def test_records_are_packed_in_files_of_bounded_length(spark, tmp_path):
    """A record repeats its sample's names, so plain files took several times the space of the documents."""
    folder = tmp_path / "a"
    for s in range(2):
        save(folder, "n", f"10-00-{5 * s:02d}", sample(*(process(p, f"frame {p}", "wait") for p in range(200))), "" if s == 0 else "_noDiff")
    save(folder, "n", "10-00-10", sample())
    tables, out, plain = read_snapshots(spark, str(folder)), str(tmp_path / "packed"), str(tmp_path / "plain")
    found = S.sample_verdicts(tables.processes, tables.samples)
    K.write_process_snapshots(tables.processes, found, out, tables.samples, rows_per_file=30)
    K.write_process_snapshots(tables.processes, found, plain, tables.samples, compression="none")
    assert sum(map(os.path.getsize, files_below(out))) < 0.3 * sum(map(os.path.getsize, files_below(plain)))
    assert len(files_below(out)) >= 15 and all(f.endswith(".json.gz") for f in files_below(out))
    for name in ("processes", "samples"):
        rows = [sorted(map(str, getattr(t, name).drop("path").collect())) for t in (tables, read_snapshots(spark, out), read_snapshots(spark, plain))]
        assert rows[0] and rows[0] == rows[1] == rows[2]


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in files_below(d.getPath()) if os.path.basename(f).startswith("shuffle_")}


def test_what_passes_is_deleted(spark):
    before = shuffle_files(spark)
    with passing(spark):
        one = stored(spark.range(1000).repartition(3).groupBy(F.col("id") % 5).count(), "one")
        with pytest.raises(ZeroDivisionError), passing(spark):
            two = stored(one, "two").inputFiles()
            1 / 0
        assert one.count() == 5 and not any(os.path.exists(f.removeprefix("file://")) for f in two)
        files = one.inputFiles()
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert os.path.dirname(work_path(spark, "three")) == _own_dir(spark)
    until = time.time() + 20  # files go a moment later
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before


def test_check_verdicts_frees_what_it_no_longer_reads(spark):
    """Documents, their rows and the first comparison are gone when the records are read back."""
    before = set(os.listdir(_own_dir(spark))) if os.path.exists(_own_dir(spark)) else set()
    assert QUERIES["check_verdicts"](spark, "/root/testdata/sf0.001").count() > 0
    left = sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(_own_dir(spark))) - before)
    assert left == ["pair-errors", "pairs", "processes-of-pairs", "samples", "snapshots", "verdicts"]
