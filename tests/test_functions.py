import datetime as dt

import pytest
from pyspark.sql import functions as F

from trainscope.functions import events, logs, parsers, stacks, text


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_extract_number(spark):
    cases = {"RANK7": 7, "7 of 9": 7, "v-12": 12, "3.25": 3, "007": 7, "none": None, "": None, "9" * 30: None,
             "x" + "9" * 18: 10**18 - 1, "9223372036854775807": 2**63 - 1}
    assert values(spark, text.extract_number, list(cases)) == list(cases.values())


def test_compare_rank(spark):
    cases = [("RANK2", "RANK10", -1), ("RANK10", "RANK2", 1), ("a5", "b5", 0), ("r-3", "r-4", -1), ("8.9", "8.1", 0),
             ("6x", "60y", -1), ("x", "RANK1", 0), ("RANK1", "x", 0), ("x", "y", 0), ("", "RANK1", 0), ("", "", 0)]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    assert df.filter(text.compare_rank("a", "b") != F.col("want")).count() == 0


def test_extract_nodes(spark):
    cases = {
        "job=7 nodes=['w0:gpu-a', 'w1:gpu-b', 'gpu-c'] state=up": ["gpu-a", "gpu-b", "gpu-c"],
        "nodes=[] state=up": [],
        "nodes=[\n\t'w0:gpu-a',\n\t 'gpu-b'\n\t]": ["gpu-a", "gpu-b"],
        "nodes=['w0:gpu a', 'w1:gpu\\nb',, 'w2:gpu\\tc' ]": ["gpua", "gpub", "gpuc"],
        "nodes=[gpu-a,gpu-b] nodes=[gpu-c]": ["gpu-a", "gpu-b"],
        "nodes=[a:b:c,,,x:]": ["b:c", ""],
        "no list here": None,
    }
    assert values(spark, text.extract_nodes, list(cases)) == list(cases.values())


def test_parse_rank_range(spark):
    got = values(spark, text.parse_rank_range, ["0:7", "invalid", "error: No launcher process found", " 3:4\n", "a:1"])
    assert [(g.min_rank, g.max_rank, g.reason is None) for g in got] == [
        (0, 7, True), (None, None, False), (None, None, False), (3, 4, True), (None, None, False)]


def test_log_time(spark):
    rows = ["2025-07-11 02:32:52", "2025-07-11 02:32:52.123", "2025-07-11 02:32:52,5", "2025-07-11  2:32:52",
            "2025-13-11 02:32:52", "2025-02-30 02:32:52", "2025-07-11 24:00:00", "2025-07-11 02:32", "x",
            "2025-07-11 02:32:52Z", "2025-7-11 02:32:52", "2025-07-11 02:32:60"]
    epoch = values(spark, lambda c: F.unix_micros(text.parse_log_time(c)), rows)
    base = int(dt.datetime(2025, 7, 11, 2, 32, 52, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    assert epoch == [base, base + 123000, base + 500000, base] + [None] * 8


def test_log_time_zone(spark):
    rows = ["2025-07-11 10:32:52"]
    got = values(spark, lambda c: F.unix_seconds(text.parse_log_time(c, "Asia/Shanghai")), rows)
    assert got == [int(dt.datetime(2025, 7, 11, 2, 32, 52, tzinfo=dt.timezone.utc).timestamp())]


def test_format_rfc3339(spark):
    rows = ["2025-07-11 02:32:52.9", "bad"]
    assert values(spark, lambda c: text.format_rfc3339(text.parse_log_time(c)), rows) == ["2025-07-11T02:32:52Z", ""]


def test_time_bound(spark):
    rows = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+08:00", "2024-01-02T03:04:05", "2024-01-02", ""]
    got = values(spark, lambda c: F.unix_seconds(text.parse_time_bound(c)), rows)
    base = int(dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc).timestamp())
    assert got == [base, base - 8 * 3600, base, None, None]


LINE = "[Job][RANK 3][2025-07-11 02:32:52][INFO] accumulation 4, compile on"


def test_log_entry(spark):
    rows = ["only words", LINE, "[a][RANK 1][2025-99-11 02:32:52][LOG_INFO] x",
            "pre [a][RANK 1][2025-07-11 02:32:52][LOG_ERROR] z [Train] (Epoch 12) y",
            "[a][RANK 1][2025-07-11 02:32:52][LOG_ERROR] [Train] (Epoch 4294967297) y",
            "[a][RANK 1][2025-07-11 02:32:52][LOG_ERROR] [Train] (Epoch 99999999999999999999) y",
            "[[a][RANK 1][2025-07-11 02:32:52][LOG_DEBUG] ", "words [Train] (Epoch 3)",
            "[a][RANK 1][2025-07-11 02:32:52][LOG_INFO]no blank"]
    got = values(spark, logs.log_entry, rows)
    assert [(g.kept, g.ts is not None, g.level, g.epoch) for g in got] == [
        (True, False, 0, 0), (True, True, 0, 0), (False, False, 2, 0), (True, True, 4, 12),
        (True, True, 4, 1), (True, True, 4, -1), (True, True, 1, 0), (True, False, 0, 0), (True, False, 0, 0)]
    assert [g.message for g in got] == rows
    short = values(spark, lambda c: logs.log_entry(c, accept_short=True), [LINE])
    assert short[0].level == 2


DUMP = """The frame stack for thread 9 is empty
Traceback for thread 81 (loader) [] (most recent call last):
    (Python) File "/opt/job/load.py", line 12, in fetch
        return queue.get(block)
    (Python) File "/opt/job/queue.py", line 40, in get
        self.ready.wait()

Traceback for thread 80 (main) [] (most recent call last):
    (Python) File "/opt/job/train.py", line 5, in <module>
        main(parse())
    (Python) File "/opt/job/train.py", line 77, in step
        loss.backward()"""


def plain(threads):
    return [(t.thread_id, t.thread_name, list(t.stack_frames)) for t in threads]


def test_stack_dump(spark):
    assert plain(values(spark, stacks.parse_stack_dump, [DUMP])[0]) == [
        (81, "loader", ['File "/opt/job/load.py", line 12, in fetch\nreturn queue.get(block)',
                        'File "/opt/job/queue.py", line 40, in get\nself.ready.wait()']),
        (80, "main", ['File "/opt/job/train.py", line 5, in <module>\nmain(parse())',
                      'File "/opt/job/train.py", line 77, in step\nloss.backward()'])]


def slow_parse(dump):
    """Line by line reading of a dump, for comparison."""
    threads = []
    for raw in dump.split("\n"):
        line = raw.removesuffix("\r")
        if line.startswith("Traceback for thread"):
            head = line.removeprefix("Traceback for thread ").partition(" (")
            ok = head[0].isdigit() and ")" in head[2]
            threads.append((int(head[0]), head[2].partition(")")[0], []) if ok else (-1, "unknown", []))
        elif not threads:
            continue
        elif "(Python) File" in line:
            threads[-1][2].append(line.replace("(Python) ", "", 1).strip())
        elif line.startswith("    ") and "File" not in line and line.strip() and threads[-1][2]:
            threads[-1][2][-1] += "\n" + line.strip()
    return threads


@pytest.mark.parametrize("seed", range(4))
def test_stack_dump_against_line_reader(spark, seed):
    import random
    rnd = random.Random(seed)
    lines = ["Traceback for thread 7 (a b) []", "Traceback for thread x", "Traceback for thread", "noise",
             '    (Python) File "a (Python) File", line 1', "(Python) File z", "    code", "\tcode", "    File code",
             "        ", "", "     deep   code  ", "Traceback for thread 8 () (Python) File \r",
             "    tail\r", " Traceback for thread 9 (q)"]
    dumps = ["\n".join(rnd.choices(lines, k=rnd.randint(0, 14))) for _ in range(300)]
    got = [plain(t) for t in values(spark, stacks.parse_stack_dump, dumps)]
    assert got == [slow_parse(d) for d in dumps]


def test_thread_header(spark):
    got = values(spark, stacks.parse_thread_header,
                 ["Traceback for thread 12 (x (y) z) []", "Traceback for thread", "Traceback for thread " + "9" * 25 + " (n)"])
    assert [tuple(g) for g in got] == [(12, "x (y"), (-1, "unknown"), (-1, "n")]


def test_process_type(spark):
    assert values(spark, stacks.process_type, ["trainer", "dataloader", "unknown", "", None]) == [1, 2, 0, 0, 0]
    assert values(spark, stacks.process_type_name, [0, 1, 2, 3, 9], "int") == [
        "PROCESS_UNSPECIFIED", "PROCESS_TRAINER", "PROCESS_DATA_LOADER", "PROCESS_LAUNCHER", "9"]


def test_severity(spark):
    assert values(spark, events.severity_code, ["INFO", "CRITICAL", "", None, "x"]) == [0, 3, 0, 0, None]
    assert values(spark, events.severity_name, [0, 1, 2, 3, 7], "int") == ["INFO", "WARNING", "ERROR", "CRITICAL", "7"]
    assert events.severity_value("ERROR") == 2
    with pytest.raises(ValueError):
        events.severity_value("error")


def test_payload(spark):
    rows = ['{"msg_type":"text","content":{"text":"hi"}}', "{", '{"content":{"text":5}}', "{}", "null", '"x"',
            '{"content":[]}', '{"content":{"text":null},"more":1}', '{"msg_type":1}', None]
    assert values(spark, events.payload_text, rows) == ["hi", None, None, "", "", None, None, "", None, None]


def test_clean_utf8(spark):
    rows = [b"plain", b"\xef\xbb\xbfmark", b"a\xffb\xc3", "é€😀".encode(), "é😀".encode("utf-16"),
            b"\xfe\xff" + "é😀".encode("utf-16-be"), b"\xff\xfea", b"\xff\xfe\x00\xd8a\x00", b""]
    got = values(spark, text.clean_utf8, [bytearray(r) for r in rows], "binary")
    assert got[:6] == ["plain", "mark", "a�b�", "é€😀", "é😀", "é😀"]
    assert all("�" in g for g in got[6:8]) and got[8] == ""


def test_environ(spark):
    env = "A=1\0RANK=3=4\0LOCAL_RANK=1\0RANK=9\0flag"
    assert values(spark, lambda c: text.environ_value(c, "RANK"), [env, "XRANK=1", ""]) == ["3", "", ""]
    assert values(spark, text.parse_environ, [env]) == [{"A": "1", "RANK": "3", "LOCAL_RANK": "1"}]


def test_trim_space(spark):
    assert values(spark, text.trim_space, ["  \tx  y　\n", "   ", "z"]) == ["x  y", "", "z"]


def test_parser_registry(spark):
    df = spark.createDataFrame([("ab",)], "v string")
    parsers.register_parser("upper", F.upper)
    assert parsers.parse_with(df, "upper", "v").first().parsed == "AB"
    assert parsers.parse_with(df, "log", "v").first().parsed.kept
    with pytest.raises(ValueError):
        parsers.parse_with(df, "none", "v")
