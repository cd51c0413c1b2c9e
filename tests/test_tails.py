"""Tails by blocks against the whole files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from trainscope.operators import logs as L
from trainscope.plans.hang_check import rank_silence
from trainscope.sources.logs import read_rank_logs
from trainscope.sources.tails import _lines_from_end, list_log_files, newest_run_files, read_tails, split_failed


class Watched:
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        self.data, self.at, self.bytes = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.bytes += n
        return self.data[self.at:self.at + n]


@pytest.mark.parametrize("seed", range(8))
def test_lines_from_the_end(seed):
    rng = random.Random(seed)
    lines = [b"x" * rng.choice([0, 0, 1, 5, 60, 500]) + (b"\r" if rng.random() < 0.2 else b"") for _ in range(rng.randrange(80))]
    for end in (b"", b"\n", b"\n\n"):
        data = b"\n".join(lines) + end
        want = data.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        for n in (1, 3, 30, 200):
            got = _lines_from_end(Watched(data), len(data), n, rng.choice([1, 7, 64]))
            assert [line for _, line in got] == want[-n:] if data else got == []
            assert all(data[at:at + len(line)] == line for at, line in got)


def test_bytes_read_do_not_follow_the_length():
    small, large = (Watched(b"a line of twenty b.\n" * n) for n in (10_000, 1_000_000))
    for source in (small, large):
        assert len(_lines_from_end(source, len(source.data), 30, 256)) == 30
    assert small.bytes == large.bytes < 2000


def write(path, text, age=0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))


def test_same_lines_as_whole_files(spark, tmp_path):
    rng = random.Random(2)
    run = str(tmp_path / "job" / "run")
    for rank in range(6):
        write(f"{run}/rank{rank}.log", "".join(f"line {i} of {rank} é{'x' * rng.randrange(200)}\n" for i in range(rng.choice([0, 1, 29, 31, 400]))))
    tails = read_tails(list_log_files(spark, run), 30, "n", block=100)
    whole = L.tail_lines(read_rank_logs(spark, run, "n"), 30)
    assert sorted((r["rank"], r.line) for r in tails.collect()) == sorted((r["rank"], r.line) for r in whole.collect())
    assert tails.filter("error is not null").count() == 0
    again = L.tail_lines(split_failed(tails)[0], 5)
    assert sorted(r.line for r in again.collect()) == sorted(r.line for r in L.tail_lines(read_rank_logs(spark, run, "n"), 5).collect())
    with pytest.raises(ValueError):
        read_tails(list_log_files(spark, run), 0)


def test_only_the_newest_run_is_read(spark, tmp_path):
    for job, run, age in (("a", "r1", 50), ("a", "r2", 10), ("b", "r1", 0), ("b", "r0", 99)):
        write(str(tmp_path / job / run / "rank0.log"), f"{job} {run}\n", age)
        write(str(tmp_path / job / run / "other.log"), "no rank\n", -99)
    files = newest_run_files(list_log_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")]))
    assert sorted(r.line for r in read_tails(files, 3).collect()) == ["a r2", "b r1"]


def test_a_file_that_is_gone_fails_alone(spark, tmp_path):
    run = str(tmp_path / "job" / "run")
    for rank in (0, 1):
        write(f"{run}/rank{rank}.log", "[t][RANK 0][2025-07-11 02:00:00][LOG_INFO] go\n")
    files = list_log_files(spark, run).cache()
    assert files.count() == 2
    os.remove(f"{run}/rank1.log")
    lines, failed = split_failed(read_tails(files, 3, "n"))
    assert [(r.rank_no, "No such file" in r.reason) for r in failed.collect()] == [(1, True)]
    ranges = spark.createDataFrame([("n", 0, 1)], "node string, min_rank int, max_rank int")
    got = rank_silence(lines, ranges, "2025-07-11T03:00:00Z", files=files.withColumn("node", F.lit("n")), failed=failed)
    assert {(r["rank"], r.suspend_seconds) for r in got.collect()} == {("RANK0", 3600), ("RANK1", -10)}
