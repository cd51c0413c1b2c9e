"""The four kinds of table derived from the driver's Parquet tables.

Every view reads its whole source table.  The rules are listed in FIXTURES.md;
``oracles.py`` states the same views in SQL.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31T00:00:00Z"
AS_OF_MS = 1_706_659_200_000
HANG_SECONDS = 150_000
SILENT_RANKS = (5, 6, 10, 15)
TIMES = {"events": "ts", "lineitem": "l_shipdate"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a source table from which one task makes texts, beyond one task a core.
DEALT = 1 << 16


def dealt(keys: DataFrame, by: str) -> DataFrame:
    """The narrow keys over all cores, before texts are made from them: a driver table is one row group, so one task.

    Tasks are as many as the rows ask for, so that what one task sorts or sends stays the same as tables grow.
    """
    tasks = max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // DEALT))
    return keys.repartition(tasks, by)


def as_utc(column: str):
    """Source times carry no zone and mean UTC."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast({column} as timestamp_ntz))"))


def label_events(events: DataFrame) -> DataFrame:
    """Events with their rank: the lines of rank 13 go to rank 12, so 13 has no log."""
    base = F.col("user_id") % 16
    rank_no = F.when(base == 13, F.lit(12)).otherwise(base).cast("int")
    return (events.withColumn("rank_no", rank_no)
            .withColumn("node", F.concat(F.lit("node"), F.expr("rank_no div 4")))
            .withColumn("rank", F.concat(F.lit("RANK"), "rank_no")))


def log_lines_of(events: DataFrame) -> DataFrame:
    level = (F.when(F.col("event_type") == "view", "LOG_INFO").when(F.col("event_type") == "click", "LOG_DEBUG")
             .when(F.col("event_type") == "signup", "LOG_WARNING").when(F.col("event_type") == "error", "LOG_ERROR")
             .otherwise("INFO"))
    # Silent ranks stopped three days early.
    back = F.when(F.col("rank_no").isin(*SILENT_RANKS), F.expr("interval 3 days")).otherwise(F.expr("interval 0 days"))
    shown = F.date_format(F.col("ts") - back, "yyyy-MM-dd HH:mm:ss")
    clock = F.when(F.col("event_id") % 101 == 100, "2024-13-01 00:00:00").otherwise(shown)
    shaped = F.concat(F.lit("[Train][RANK "), "rank_no", F.lit("]["), clock, F.lit("]["), level,
                      F.lit("] [Train] (Epoch "), F.expr("event_id div 500"), F.lit(") step "), "props")
    line = F.when((F.col("event_id") % 17 == 16) & (F.col("event_id") % 101 != 100),
                  F.concat(F.lit("free text "), "event_id")).otherwise(shaped)
    return label_events(events).select(
        "node", "rank_no", "rank", F.col("event_id").alias("line_no"), line.alias("line"),
        F.lit("2024-01-30T00:00:00Z").cast("timestamp").alias("file_mtime"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines_of(table(spark, sf_dir, "events"))


def event_store_of(events: DataFrame) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))")
    kind = F.col("event_id") % 3
    done = F.col("event_id") % 4 == 0
    severity = (F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2)
                .when(F.col("event_type") == "purchase", 3).otherwise(0))
    return label_events(events).withColumn("timestamp", ms).select(
        F.concat(F.lit("e"), "event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "training").otherwise("system").alias("source"),
        F.when(kind == 0, "alert").when(kind == 1, "audit").otherwise("metric").alias("type"),
        F.concat(F.lit("job"), F.col("user_id") % 10).alias("job_id"),
        F.col("props").alias("message"), "timestamp", severity.alias("severity"), done.alias("processed"),
        F.when(done, F.col("timestamp") + 1000).otherwise(F.lit(0).cast("bigint")).alias("processed_at"), "node",
        F.concat(F.lit("rank"), "rank_no", F.lit("_events_"), F.date_format("ts", "yyyyMMdd")).alias("path"))


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store_of(table(spark, sf_dir, "events"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks from line items: several per event, some for events that do not exist."""
    days = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01', cast(l_shipdate as timestamp_ntz))")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("e"), F.col("l_orderkey") * 3).alias("id"), (F.col("l_linestatus") == "F").alias("processed"),
        (days * 86_400_000).alias("processed_at"), (days * 10 + F.col("l_linenumber")).alias("seq"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five samples of one process per order, with every kind of difference and error."""
    node_no = "(o_orderkey % 8)"
    # On node 7 some processes end before the last sample.
    lives = F.expr(f"explode(sequence(0, case when {node_no} = 7 and o_orderkey % 100 = 7 then 3 else 4 end))")
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    base = (orders.select("o_orderkey", "o_custkey", lives.alias("snapshot_no"))
            .withColumn("node", F.expr(f"concat('node', {node_no})"))
            .withColumn("rank_no", F.expr("(o_orderkey div 512) % 64")))
    # On node 6 some restart under a new pid in sample 3, on node 5 some change rank in sample 2.
    pid = F.expr(f"o_orderkey + case when {node_no} = 6 and o_orderkey % 100 = 6 and snapshot_no = 3 then 1000000000 else 0 end")
    moved = f"{node_no} = 5 and o_orderkey % 100 = 5 and snapshot_no = 2"
    rank = F.expr(f"concat(case when {node_no} = 4 and snapshot_no = 1 then 'rank' else 'RANK' end,"
                  f" rank_no + case when {moved} then 1 else 0 end)")
    threads = F.expr("""
        1 + o_custkey % 3 - case when snapshot_no = 3 and o_orderkey % 29 = 0 and o_custkey % 3 > 0 then 1 else 0 end""")
    base = base.select("o_orderkey", "o_custkey", "snapshot_no", "node", "rank_no", pid.alias("pid"), rank.alias("rank"),
                       threads.cast("int").alias("n_threads"))
    key, cust, sample = F.col("o_orderkey"), F.col("o_custkey"), F.col("snapshot_no")
    word = F.when((sample == 4) & (key % 41 == 0), "FILE").otherwise("File")

    def frame(k: int):
        moved = F.when(key % 11 == 0, sample).otherwise(0) if k == 3 else F.lit(0)
        return F.concat(word, F.lit(' "mod'), (cust + k) % 97, F.lit('.py", line '), moved + k * 10, F.lit(", in f"))

    def thread(t: int):
        other_id = (sample == 1) & (key % 37 == 0) & (F.col("n_threads") == t)
        frames = F.col("frames")
        if t == 1:
            frames = F.when((sample == 2) & (key % 31 == 0), F.slice(frames, 1, 3)).otherwise(frames)
        return F.struct((F.lit(t) + F.when(other_id, 100).otherwise(0)).alias("thread_id"),
                        F.lit(f"thread-{t}").alias("thread_name"), frames.alias("stack_frames"))

    base = base.withColumn("frames", F.array(*[frame(k) for k in range(1, 5)]))
    stacks = F.slice(F.array(*[thread(t) for t in range(1, 4)]), F.lit(1), F.col("n_threads"))
    ordered = F.when(F.col("snapshot_no") % 2 == 1, F.reverse("stacks")).otherwise(F.col("stacks"))
    clock = F.concat(F.lit("2024-01-31 00:00:"), F.lpad((F.col("snapshot_no") * 5).cast("string"), 2, "0"))
    return base.withColumn("stacks", stacks).select(
        "node", "snapshot_no", clock.alias("snapshot_time"), "pid", "rank",
        F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1).alias("type"), ordered.alias("threads"))


def save_check_documents(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Two checks of three samples on each of 24 nodes, saved as one document a sample, ``{}`` if empty, some cut short.

    Some samples of the second check are empty, some are broken.  The first frame moves between checks, the second
    between samples.  On some nodes the second check follows soon, and on some its first sample is lost, so that only the
    name of the file, or only the pause, tells the checks apart.

    A sample holds many processes, so its document is written process by process and never held whole; the narrow
    keys are sorted, and the texts are made after that.  The files are packed: their text is much alike.
    """
    k = F.col("k")
    second = F.when(k % 4 == 2, "10:00:").otherwise("11:00:")
    start = F.when((F.col("c") == 1) & (k % 4 == 2), 40).otherwise(0)
    clock = F.concat(F.when(F.col("c") == 0, "10:00:").otherwise(second), F.lpad((start + F.col("s") * 5).cast("string"), 2, "0"))
    marked = (F.col("s") > 0) | ((F.col("c") == 1) & (k % 4 == 0))
    frames = F.array(F.concat(F.lit('File "mod'), F.col("o_custkey") % 97, F.lit('.py", line '), F.col("c") * 100 + 1),
                     F.concat(F.lit('File "step.py", line '), F.when((k % 3 == 0) & (F.col("o_orderkey") % 11 == 0), F.col("s")).otherwise(0)))
    thread = F.struct(F.lit(1).alias("threadId"), F.lit("main").alias("threadName"), frames.alias("stackFrames"))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    file = F.concat(F.lit("nodegpu"), k, F.lit("_processInfo_2024-01-31_"), F.translate(clock, ":", "-"), F.when(marked, "_noDiff").otherwise(""))
    keys = (orders.withColumn("k", F.col("o_orderkey") % 24)
            .withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("s", F.explode(F.array(*map(F.lit, range(3)))))
            .withColumn("file", file).repartition("file").sortWithinPartitions("file", "c", "s"))
    process = F.struct(F.col("o_orderkey").cast("int").alias("pid"),
                       F.when(F.col("o_orderkey") % 5 == 0, "PROCESS_DATA_LOADER").otherwise("PROCESS_TRAINER").alias("type"),
                       F.concat(F.lit("RANK"), F.expr("(o_orderkey div 24) % 64")).alias("rank"), F.array(thread).alias("threads"))
    kind = (F.when((F.col("c") == 1) & (F.col("s") == 1) & (k % 5 == 3), "empty")
            .when((F.col("c") == 1) & (F.col("s") == 2) & (k % 6 == 1), "short").otherwise("whole"))
    rows = keys.select(F.coalesce("file", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("file"), (F.col("c") * 3 + F.col("s")).alias("sample"),
                       kind.alias("kind"), F.to_json(process).alias("process"))
    system, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "/", path))

    def write(batches):
        system.create_dir(inner)
        now, out, n = (None, None, None), None, 0

        def finish():
            tail = f'],"totalCount":{n}}}'
            if out is not None:
                out.write(("{}" if now[2] == "empty" else tail[:-9] if now[2] == "short" else tail).encode() + b"\n\n")

        for batch in batches:
            files, samples, kinds, texts = (batch.column(c).to_pylist() for c in ("file", "sample", "kind", "process"))
            at = 0
            while at < len(files):
                own = (files[at], samples[at], kinds[at])
                end = at
                while end < len(files) and (files[end], samples[end]) == own[:2]:
                    end += 1
                if own != now:
                    finish()
                    if own[0] != now[0]:
                        if out is not None:
                            out.close()
                        system.create_dir(f"{inner}/file={own[0]}")
                        out = system.open_output_stream(f"{inner}/file={own[0]}/part-0.txt.zst")
                    now, n = own, 0
                    if own[2] != "empty":
                        out.write(b'{"processes":[')
                if own[2] != "empty":
                    out.write((("," if n else "") + ",".join(texts[at:end])).encode())
                n, at = n + end - at, end
            yield batch.select(["file"]).slice(0, 0)
        finish()
        if out is not None:
            out.close()

    rows.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stack dump per order: a note before the first header, then threads, frames and code lines."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def frame(k: int) -> list:
        code = "        call(a, b)\n\n" if k % 2 == 0 else "        x = 1\n        y = 2\n"
        return [F.lit('    (Python) File "mod'), (cust + k) % 97, F.lit(f'.py", line {k * 10}, in f\n{code}')]

    def thread(t: int):
        name = F.when(key % 13 == 0, "x").otherwise("2") if t == 2 else F.lit(str(t))
        orphan = F.when(key % 7 == 0, "    orphan code\n").otherwise("")
        text = F.concat(F.lit("Traceback for thread "), name, F.lit(" ("), "o_orderpriority",
                        F.lit(") [] (most recent call last):\n"), orphan, "body")
        return F.when(cust % 3 >= t - 1, text)

    note = 'The frame stack for thread 1 is empty\n    (Python) File "early.py", line 1, in f\n'
    body = F.concat(*[part for k in range(1, 5) for part in frame(k)])
    dump = F.concat(F.lit(note), F.concat_ws("\n", *[thread(t) for t in range(1, 4)]))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    return (orders.withColumn("body", body)
            .select(F.concat(F.lit("node"), key % 8).alias("node"), key.alias("pid"), dump.alias("dump")))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One launcher per node; each order is a trainer or a data worker."""
    orders = (dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
              .select("o_orderkey", F.expr("cast(o_orderkey % 8 as int)").alias("node_no")))
    worker = F.col("o_orderkey") % 5 == 0
    environ = F.when(F.col("o_orderkey") % 37 == 0, F.lit("HOME=/root\0LOCAL_RANK=1")).otherwise(F.concat(
        F.lit("HOME=/root\0RANK="), F.col("o_orderkey"), F.lit("\0LOCAL_RANK="), F.col("o_orderkey") % 8, F.lit("\0")))
    children = orders.select(
        F.concat(F.lit("node"), "node_no").alias("node"), F.col("o_orderkey").alias("pid"),
        F.when(worker, F.col("o_orderkey") - 8).otherwise(-1000 - F.col("node_no")).cast("bigint").alias("ppid"),
        F.when(worker, "pt_data_worker").otherwise("python").alias("name"),
        F.lit("python train.py").alias("cmdline"), F.when(worker, F.lit("")).otherwise(environ).alias("environ"))
    roots = orders.select("node_no").distinct().select(
        F.concat(F.lit("node"), "node_no").alias("node"), (-1000 - F.col("node_no")).cast("bigint").alias("pid"),
        F.lit(1).cast("bigint").alias("ppid"), F.lit("torchrun").alias("name"),
        F.lit("python -m torchrun train.py").alias("cmdline"), F.lit("").alias("environ"))
    return children.unionByName(roots)


def rpc_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_returnflag").alias("method"), F.when(F.col("l_linestatus") == "F", "x").alias("error"),
        (F.col("l_extendedprice") / 10000).alias("duration"), as_utc("l_shipdate").alias("ts"),
        F.concat(F.lit("host"), F.col("l_suppkey") % 4).alias("instance"))


def rpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpc_of(table(spark, sf_dir, "lineitem"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.lit("version").alias("op"), F.col("s_name").alias("node"), F.concat(F.lit("1."), F.col("s_nationkey") % 3).alias("version"),
        F.when(F.col("s_suppkey") % 7 == 0, "connection refused").alias("error"))


def asked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the event store, one that failed and one without events."""
    seen = label_events(table(spark, sf_dir, "events")).select("node").distinct()
    return (seen.withColumn("error", F.when(F.col("node") == "node3", "Failed to connect to node node3"))
            .unionByName(seen.agg(F.lit("node9").alias("node"), F.lit(None).cast("string").alias("error"))))


def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 13 == 0, F.concat(F.lit("no list for "), "c_name")).otherwise(F.concat(
        F.lit("job nodes=['"), "c_name", F.lit(":h"), "c_custkey", F.lit("', \n 'h"), "c_nationkey", F.lit("'] end")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), text.alias("description"))


def run_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/runs/job"), F.col("o_custkey") % 50).alias("work_dir"),
        F.concat(F.lit("/runs/job"), F.col("o_custkey") % 50, F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"),
        as_utc("o_orderdate").alias("mtime"), (F.col("o_orderstatus") != "F").alias("is_dir"))


def rank_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected ranks per node of the log lines: four each."""
    nodes = label_events(table(spark, sf_dir, "events")).select("node").distinct()
    low = F.substring("node", 5, 9).cast("int") * 4
    return nodes.select("node", low.alias("min_rank"), (low + 3).alias("max_rank"))


def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as bytes: with a mark, as UTF-16, or twice with a bad byte between."""
    utf8 = F.encode("text", "UTF-8")
    raw = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
           .when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16"))
           .otherwise(F.concat(utf8, F.unhex(F.lit("FF")), utf8)))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.select("doc_id", raw.alias("raw"))


def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = (F.when(key % 5 == 0, F.concat(F.lit("error: no launcher on "), key))
            .when(key % 5 == 1, F.concat(key, F.lit(" "), cust))
            .when(key % 5 == 2, F.concat(F.lit("a"), key, F.lit(":"), cust))
            .otherwise(F.concat(F.lit(" "), key, F.lit(":"), cust, F.lit("\n"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("output"))


def bound_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(key % 4 == 0, F.concat(stamp, F.lit("Z"))).when(key % 4 == 1, stamp)
            .when(key % 4 == 2, F.concat(stamp, F.lit("+08:00"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("bound"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted messages with whole conversation turns as text; every fifth conversation sends broken JSON."""
    good = F.to_json(F.struct(F.lit("text").alias("msg_type"), F.struct("text").alias("content")))
    body = (F.when(F.col("conv_id") % 5 == 1, F.substring(good, F.lit(1), F.length(good) - 1))
            .when(F.col("conv_id") % 5 == 2, F.concat(F.lit('{"content":{"text":'), "turn", F.lit("}}"))).otherwise(good))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))


def save_rank_logs(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``log_lines`` as files of two runs below ``path``: first ``old``, where each line begins with "old", then ``new``."""
    def save(folder: str):
        system, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "/", f"{path}/{folder}"))
        prefix = b"old " if folder == "old" else b""

        def write(batches):
            rank, out = None, None
            system.create_dir(inner)
            for batch in batches:
                for no, line in zip(batch.column("rank_no").to_pylist(), batch.column("line").to_pylist()):
                    if no != rank:
                        if out is not None:
                            out.close()
                        rank, out = no, system.open_output_stream(f"{inner}/rank{no}.log")
                    out.write(prefix + line.encode() + b"\n")
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_pydict({"rank_no": pa.array([rank], pa.int32())})
        return write

    lines = log_lines(spark, sf_dir).select("rank_no", "line_no", "line").repartition("rank_no").sortWithinPartitions("rank_no", "line_no")
    for folder in ("old", "new"):
        lines.select("rank_no", "line").mapInArrow(save(folder), "rank_no int").write.format("noop").mode("overwrite").save()


def save_event_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``event_store`` as JSON files by rank and day, ``{"events": [...]}``; those of rank 3 are cut short."""
    fields = ("id", "source", "type", "job_id", "message", "timestamp", "severity", "processed", "processed_at")
    one = event_store(spark, sf_dir).groupBy("path").agg(F.collect_list(F.struct(*fields)).alias("events"))
    text = F.when(F.col("path").startswith("rank3_"), F.expr("left(text, length(text) - 5)")).otherwise(F.col("text"))
    files = one.select("path", F.to_json(F.struct("events")).alias("text")).select("path", text.alias("text"))
    system, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "/", path))

    def write(batches):
        system.create_dir(inner)
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                with system.open_output_stream(f"{inner}/{name}.json") as out:
                    out.write(body.encode())
            yield batch.select(["path"])

    files.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def batches(spark: SparkSession, sf_dir: str, name: str, n: int, path: str) -> DataFrame:
    """A driver table as a stream of ``n`` batches that each hold rows of the whole time."""
    source = table(spark, sf_dir, name)
    for k in range(n):
        source.filter(F.pmod(F.xxhash64(*source.columns), F.lit(n)) == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)


def closing_beat(spark: SparkSession, sf_dir: str, name: str, days: int, path: str, batches: int = 1) -> DataFrame:
    """A stream of times: in the last of its batches one that lies so many days after all of the table, before that the first."""
    seen = table(spark, sf_dir, name).agg(F.min(as_utc(TIMES[name])).alias("first"), F.max(as_utc(TIMES[name])).alias("last"))
    for _ in range(batches - 1):
        seen.select(F.col("first").alias("ts")).write.mode("append").parquet(path)
    last = seen.select((F.col("last") + F.make_dt_interval(F.lit(days))).alias("ts"))
    last.write.mode("append").parquet(path)
    return spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(path)


def expected_ranks(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """A stream of the ranks of all nodes with a start a month before the first event, rank 13 among them."""
    start = table(spark, sf_dir, "events").agg(F.date_trunc("day", F.min(as_utc("ts")) - F.expr("interval 30 days")).alias("ts"))
    ranks = rank_ranges(spark, sf_dir).select("node", F.explode(F.sequence("min_rank", "max_rank")).alias("n"))
    due = ranks.select("node", F.concat(F.lit("RANK"), "n").alias("rank"), F.lit(start.first()["ts"]).alias("ts"))
    due.coalesce(1).write.parquet(path)
    return spark.readStream.schema(due.schema).parquet(path)
