"""Every operator as a query over the driver's tables.

Nested results are flattened here, so that they compare with SQL by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscope import fixtures as X
from trainscope.functions import events as FE
from trainscope.functions import text as FT
from trainscope.functions.parsers import parse_with, register_parser
from trainscope.functions.stacks import parse_stack_dump
from trainscope.operators import events as E
from trainscope.operators import fleet as V
from trainscope.operators import logs as L
from trainscope.operators import processes as P
from trainscope.operators import snapshots as S
from trainscope.plans.alert_check import alert_check
from trainscope.plans.hang_check import hang_check, rank_silence
from trainscope.plans.reports import log_report, stack_report
from trainscope.schemas import LEDGER_SCHEMA
from trainscope.session import ending_shuffles, passing, work_path
from trainscope.sinks import tables as K
from trainscope.sinks.event_index import read_event_index, read_matching_events, update_event_index
from trainscope.sources.events import parse_event_payloads, read_event_files, read_event_store, rejected_event_files
from trainscope.sources.logs import read_node_list
from trainscope.sources.snapshots import Snapshots, read_snapshots
from trainscope.sources.tails import list_log_files, newest_run_files, read_tails, split_failed
from trainscope.streaming import alerts as SA
from trainscope.streaming import ledger as G
from trainscope.streaming.hang import stream_hang_detection
from trainscope.streaming.metrics import running_totals, stream_request_metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WINDOW = E.EventFilter(start_ms=1_704_412_800_000, end_ms=1_705_708_800_000, min_severity=1, type="alert",
                       source="system", unprocessed=True)
POLL = E.poll_window(1_705_276_800_000, X.AS_OF_MS, 1)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- rank logs ---------------------------------------------------------------------

def _status(spark: SparkSession, sf: str) -> DataFrame:
    return rank_silence(X.log_lines(spark, sf), None, X.AS_OF)


@query
def log_tail(spark, sf):
    return L.tail_lines(X.log_lines(spark, sf)).select("node", "rank", "line_no", "line")


@query
def log_parse(spark, sf):
    return L.parse_log_lines(X.log_lines(spark, sf)).select(
        "node", "rank", "line_no", FT.format_rfc3339("ts").alias("ts"), "level", "epoch", "message")


@query
def log_epoch(spark, sf):
    return L.parse_log_lines(X.log_lines(spark, sf)).groupBy("node", "rank").agg(
        F.max("epoch").alias("epoch"), F.count("*").alias("entries"))


@query
def latest_log_time(spark, sf):
    return _status(spark, sf).select("node", "rank", "entries", FT.format_rfc3339("latest").alias("latest"))


@query
def suspend_seconds(spark, sf):
    return _status(spark, sf).select("node", "rank", "suspend_seconds")


@query
def suspicious_ranks(spark, sf):
    return L.suspicious_ranks(_status(spark, sf), X.HANG_SECONDS).select("node", "rank", "suspend_seconds")


@query
def suspicious_nodes(spark, sf):
    status = rank_silence(X.log_lines(spark, sf), X.rank_ranges(spark, sf), X.AS_OF, inclusive=False)
    return L.suspicious_nodes(status, X.HANG_SECONDS)


@query
def suspicious_nodes_inclusive(spark, sf):
    status = rank_silence(X.log_lines(spark, sf), X.rank_ranges(spark, sf), X.AS_OF, inclusive=True)
    return L.suspicious_nodes(status, X.HANG_SECONDS)


@query
def rank_range_filter(spark, sf):
    return L.filter_rank_range(X.log_lines(spark, sf), X.rank_ranges(spark, sf), inclusive=False).select("node", "rank", "line_no")


@query
def missing_ranks(spark, sf):
    done = rank_silence(X.log_lines(spark, sf), X.rank_ranges(spark, sf), X.AS_OF, inclusive=True)
    return done.select("node", "rank", "entries", "suspend_seconds", F.coalesce("marker", F.lit("")).alias("marker"))


@query
def rank_logs_nested(spark, sf):
    report = log_report(X.log_lines(spark, sf), X.AS_OF)
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws("|", e["timestamp"], e["level"], e["epoch"], e["message"])), "\n")
    return report.select("node", "rank", F.size("entries").alias("n_entries"), text.alias("entries"),
                         "suspend_seconds", "tail_time")


@query
def rank_log_records(spark, sf):
    """Written as JSON records and read back; zero levels and epochs are left out of them."""
    out = work_path(spark, "rank-logs")
    K.write_rank_logs(log_report(X.log_lines(spark, sf), X.AS_OF), out, "job")
    entry = "struct<timestamp:string,level:int,epoch:int,Message:string>"
    records = spark.read.schema(f"rank string, entries array<{entry}>, suspend_seconds int, tail_time string, job string, selection string").json(out)
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws("|", e["timestamp"], F.coalesce(e["level"], F.lit(0)), F.coalesce(e["epoch"], F.lit(0)),
                                                                     e["Message"])), "\n")
    return records.select("rank", text.alias("entries"), "suspend_seconds", "tail_time", "selection")


@query
def rank_filter(spark, sf):
    return L.filter_rank_logs(X.log_lines(spark, sf), "RANK3").select("node", "rank", "line_no", "line")


@query
def rank_compare(spark, sf):
    return X.event_store(spark, sf).select(
        "id", FT.extract_number("path").alias("number"), FT.compare_rank("path", "job_id").alias("sign"))


@query
def highest_rank(spark, sf):
    return L.highest_rank(X.log_lines(spark, sf).select("rank").distinct())


@query
def rank_order(spark, sf):
    return L.order_by_rank(X.log_lines(spark, sf).select("node", "rank").distinct())


@query
def oversized_ranks(spark, sf):
    return L.oversized_ranks(X.log_lines(spark, sf), limit=77).select("node", "rank", "line_bytes")


def _saved_logs(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "runs")
    X.save_rank_logs(spark, sf, path)
    return list_log_files(spark, path)


def _node_of_rank():
    return F.concat(F.lit("node"), F.expr("rank_no div 4"))


@query
def rank_log_files(spark, sf):
    return _saved_logs(spark, sf).select(F.substring_index("run", "/", -1).alias("run"), "rank", "length")


@query
def tail_blocks(spark, sf):
    tails = read_tails(_saved_logs(spark, sf), node=_node_of_rank(), block=64)
    return tails.select("node", F.regexp_extract("path", r"/(\w+)/[^/]+\z", 1).alias("run"), "rank", "line")


@query
def newest_run_tail(spark, sf):
    lines, _ = split_failed(read_tails(newest_run_files(_saved_logs(spark, sf)), node=_node_of_rank()))
    status = rank_silence(lines, None, X.AS_OF)
    return status.select("node", "rank", "entries")


@query
def latest_run_dir(spark, sf):
    return L.latest_run_dir(X.run_dirs(spark, sf)).select("work_dir", "path", FT.format_rfc3339("mtime").alias("mtime"))


@query
def clean_utf8(spark, sf):
    return X.encoded_texts(spark, sf).select("doc_id", FT.clean_utf8("raw").alias("text"))


@query
def extract_nodes(spark, sf):
    return V.job_nodes(X.job_texts(spark, sf)).select("job", "node")


@query
def rank_range_text(spark, sf):
    return (X.range_texts(spark, sf).select("o_orderkey", FT.parse_rank_range("output").alias("r"))
            .select("o_orderkey", F.coalesce("r.min_rank", F.lit(-1)).alias("min_rank"),
                    F.coalesce("r.max_rank", F.lit(-1)).alias("max_rank"), F.col("r.reason").isNull().alias("good")))


@query
def time_bounds(spark, sf):
    return X.bound_texts(spark, sf).select(
        "o_orderkey", FT.format_rfc3339(FT.parse_time_bound("bound")).alias("bound"))


@query
def time_range(spark, sf):
    texts = X.bound_texts(spark, sf)
    start = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("bound"))
    end = F.when(F.col("o_orderkey") % 5 != 0, F.col("bound"))
    return texts.withColumn("b", FT.time_bounds(start, end, X.AS_OF_MS)).select("o_orderkey", "b.start_ms", "b.end_ms", F.coalesce("b.reason", F.lit("")).alias("reason"))


# --- processes and stacks -------------------------------------------------------------

@query
def process_tree(spark, sf):
    return P.process_tree(X.processes(spark, sf))


@query
def process_environ(spark, sf):
    variables = FT.parse_environ("environ")
    return X.processes(spark, sf).select(
        "node", "pid", F.coalesce(F.try_element_at(variables, F.lit("RANK")), F.lit("")).alias("rank"),
        F.coalesce(F.try_element_at(variables, F.lit("HOME")), F.lit("")).alias("home"))


@query
def rank_range(spark, sf):
    return P.rank_range(X.processes(spark, sf))


@query
def process_filter(spark, sf):
    return P.filter_processes(P.labelled(P.process_tree(X.processes(spark, sf))), type=2)


@query
def process_rank_filter(spark, sf):
    return P.filter_processes(P.labelled(P.process_tree(X.processes(spark, sf))), rank="rank17")


@query
def process_counts(spark, sf):
    return P.process_counts(X.snapshots(spark, sf))


@query
def stack_parse(spark, sf):
    threads = X.dumps(spark, sf).select("node", "pid", F.posexplode(parse_stack_dump("dump")).alias("place", "t"))
    return threads.select("node", "pid", "place", "t.thread_id", "t.thread_name",
                          F.size("t.stack_frames").alias("frames"), F.array_join("t.stack_frames", "|").alias("stack"))


@query
def stack_reports(spark, sf):
    report = stack_report(X.processes(spark, sf), X.dumps(spark, sf), type=1)
    return report.select("node", "pid", "ppid", "type", "rank", "local_rank", F.size("threads").alias("threads"),
                         F.coalesce(F.get("threads.thread_name", F.lit(0)), F.lit("")).alias("first_thread"))


@query
def previous_snapshot(spark, sf):
    return S.previous_snapshot(X.snapshots(spark, sf)).select(
        "node", "snapshot_no", "pid", F.size("threads").alias("threads"),
        F.when(F.col("previous_threads").isNull(), F.lit(-1)).otherwise(F.size("previous_threads")).alias("previous"))


@query
def snapshot_errors(spark, sf):
    return S.pair_errors(X.snapshots(spark, sf))


@query
def snapshot_pairs(spark, sf):
    return S.snapshot_pairs(X.snapshots(spark, sf)).select(
        "node", "snapshot_no", "pid", F.col("now.rank").alias("rank"), F.size("now.threads").alias("threads"),
        F.size("then.threads").alias("previous"))


@query
def stack_diff(spark, sf):
    return S.stack_diffs(X.snapshots(spark, sf))


@query
def snapshot_verdict(spark, sf):
    snaps = X.snapshots(spark, sf)
    return S.sample_verdicts(snaps).withColumn("error", F.coalesce("error", F.lit("")))


@query
def suspect_stacks(spark, sf):
    nodes = L.suspicious_nodes(_status(spark, sf), X.HANG_SECONDS)
    return S.stacks_for_suspects(X.snapshots(spark, sf), nodes).select("node", "snapshot_no", "pid", "rank")


@query
def hang_verdicts(spark, sf):
    report = hang_check(X.log_lines(spark, sf), X.snapshots(spark, sf), X.AS_OF, X.rank_ranges(spark, sf),
                        threshold=X.HANG_SECONDS)
    return report.nodes.join(report.verdicts, "node", "left").select(
        "node", "rank", "suspend_seconds", "snapshot_no", "verdict", "diffs", F.coalesce("error", F.lit("")).alias("error"))


def _saved(spark: SparkSession, sf: str) -> Snapshots:
    path = work_path(spark, "checks")
    X.save_check_documents(spark, sf, path)
    return read_snapshots(spark, path)


@query
def snapshot_files(spark, sf):
    frame = F.col("threads")[0]["stack_frames"]
    return _saved(spark, sf).processes.select("node", "check_id", "snapshot_no", "snapshot_time", "pid", "rank", "type",
                                              frame[0].alias("first_frame"), frame[1].alias("second_frame"))


@query
def snapshot_samples(spark, sf):
    return _saved(spark, sf).samples.select("node", "check_id", "snapshot_no", "snapshot_time", "n_processes")


@query
def snapshot_rejects(spark, sf):
    return _saved(spark, sf).rejects.where("part = 0").select("node", "snapshot_time", F.substring("content", 1, 14).alias("beginning"))


@query
def check_verdicts(spark, sf):
    """Written with their verdicts, read back and compared again."""
    path = work_path(spark, "verdicts")
    with passing(spark):
        saved = _saved(spark, sf)
        found = S.sample_verdicts(saved.processes, saved.samples)
        K.write_process_snapshots(saved.processes, found, path, saved.samples)
    with ending_shuffles(spark):
        again = read_snapshots(spark, path)
        verdicts = S.sample_verdicts(again.processes, again.samples)
    return verdicts.withColumn("error", F.coalesce("error", F.lit("")))


# --- events and alerts ---------------------------------------------------------------

_EVENT = ["id", "source", "type", "job_id", "message", "timestamp", "severity", "processed", "processed_at"]


@query
def event_filter(spark, sf):
    return E.filter_events(X.event_store(spark, sf), WINDOW).select(*_EVENT)


@query
def event_defaults(spark, sf):
    bare = F.col("timestamp") % 2 == 0
    raw = (X.event_store(spark, sf).withColumn("id", F.when(bare, F.lit("")).otherwise(F.col("id")))
           .withColumn("type", F.when(bare, F.lit("")).otherwise(F.col("type")))
           .withColumn("timestamp", F.when(F.col("severity") == 3, F.lit(0)).otherwise(F.col("timestamp"))))
    fresh = F.sha2(F.concat_ws("/", "path", "job_id", "processed_at", "message"), 256)
    return E.event_defaults(raw, X.AS_OF_MS, fresh).select("id", "type", "timestamp", "message")


@query
def event_payload(spark, sf):
    parsed = parse_event_payloads(X.payloads(spark, sf), "body")
    return parsed.select("conv_id", "turn", "source", "type", "severity", "rejected",
                         F.coalesce("message", F.lit("")).alias("message"))


@query
def event_latest(spark, sf):
    return E.newest_first(X.event_store(spark, sf)).select("id", "timestamp", "message")


@query
def alert_records(spark, sf):
    return E.alert_projection(X.event_store(spark, sf), "id").select(
        "id", "message", F.unix_micros("timestamp").alias("micros"), FE.severity_name("severity").alias("severity"),
        FE.severity_code(FE.severity_name("severity")).alias("code"))


@query
def event_file_index(spark, sf):
    index = E.event_file_index(X.event_store(spark, sf))
    return index.withColumn("event_types", F.array_join("event_types", ","))


@query
def event_file_prune(spark, sf):
    events = X.event_store(spark, sf)
    return E.prune_event_files(events, E.event_file_index(events), WINDOW).select("path", "id")


@query
def apply_processed(spark, sf):
    return E.apply_processed(X.event_store(spark, sf), X.ledger(spark, sf)).select("id", "processed", "processed_at")


@query
def unprocessed_alerts(spark, sf):
    alerts = E.filter_events(X.event_store(spark, sf), E.EventFilter(type="alert"))
    return E.unprocessed(alerts, X.ledger(spark, sf)).select("node", "id", "timestamp", "severity")


def _check(spark: SparkSession, sf: str):
    return alert_check(X.event_store(spark, sf), X.ledger(spark, sf), X.asked_nodes(spark, sf), POLL,
                       X.AS_OF_MS, 7, "2024-01-31 00:00:00")


@query
def alert_window(spark, sf):
    return E.filter_events(X.event_store(spark, sf), POLL).select("node", "id", "timestamp", "severity")


@query
def alert_rollup(spark, sf):
    return _check(spark, sf).rollup.withColumn("error", F.coalesce("error", F.lit("")))


@query
def alert_numbering(spark, sf):
    return E.number_alerts(X.event_store(spark, sf)).select("node", "id", "timestamp", "alert_no")


@query
def alert_messages(spark, sf):
    messages = _check(spark, sf).messages
    return messages.select("node", "part", "text", F.get_json_object("payload", "$.content.text").alias("sent"))


@query
def alert_marks(spark, sf):
    return _check(spark, sf).marks


@query
def event_store_day(spark, sf):
    """Through the Parquet store and back, one filter over it."""
    path = work_path(spark, "event-store")
    K.append_events(X.event_store(spark, sf).drop("path"), path)
    return E.filter_events(read_event_store(spark, path), WINDOW).select(*_EVENT)


@query
def event_files_read(spark, sf):
    path = work_path(spark, "event-files")
    X.save_event_files(spark, sf, path)
    return read_event_files(spark, path).select(*_EVENT)


@query
def event_files_rejected(spark, sf):
    path = work_path(spark, "event-files")
    X.save_event_files(spark, sf, path)
    return rejected_event_files(spark, path).select(F.regexp_extract("path", r"([^/]*)\.json\z", 1).alias("path"))


@query
def node_list(spark, sf):
    """A list with blank lines and white space around the names."""
    path = work_path(spark, "nodes")
    nodes = X.event_store(spark, sf).select("node").distinct()
    nodes.select(F.concat(F.lit(" \t"), "node", F.lit(" ")).alias("value")).unionByName(nodes.select(F.lit("  ").alias("value"))).write.text(path)
    return read_node_list(spark, path)


@query
def parser_registry(spark, sf):
    """A parser of one's own beside those of the library."""
    register_parser("step", lambda line: F.regexp_extract(line, r"\(Epoch (\d+)\)", 1))
    lines = parse_with(parse_with(X.log_lines(spark, sf), "log", "line", "entry"), "step", "line", "step")
    return lines.select("rank", "line_no", F.col("entry.level").alias("level"), "step")


def _indexed_store(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Two lots of events, indexed one after the other."""
    store, index = work_path(spark, "event-store"), work_path(spark, "event-index")
    events = X.event_store(spark, sf).drop("path")
    for part in (0, 1):
        K.append_events(events.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part), store, 2000)
        update_event_index(spark, store, index)
    return store, index


@query
def event_index_stored(spark, sf):
    index = read_event_index(spark, _indexed_store(spark, sf)[1])
    return index.groupBy("event_date").agg(F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.max("max_severity").alias("max_severity"),
                                           F.sum("rows").alias("events"))


@query
def event_store_pruned(spark, sf):
    return read_matching_events(spark, *_indexed_store(spark, sf), WINDOW).select(*_EVENT)


# --- fleet -----------------------------------------------------------------------------

@query
def version_report(spark, sf):
    return V.version_report(X.agents(spark, sf)).withColumn("versions", F.array_join("versions", ","))


@query
def version_counts(spark, sf):
    return V.version_counts(X.agents(spark, sf))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    asked = X.asked_nodes(spark, sf).withColumn("op", F.lit("alerts"))
    return V.union_results(X.agents(spark, sf), asked)


@query
def failure_summary(spark, sf):
    return V.failure_summary(_answers(spark, sf))


@query
def failure_messages(spark, sf):
    return V.failure_messages(_answers(spark, sf))


@query
def union_results(spark, sf):
    return _answers(spark, sf).select("op", "node", F.coalesce("version", F.lit("")).alias("version"))


@query
def distinct_nodes(spark, sf):
    return V.distinct_nodes(X.snapshots(spark, sf))


@query
def request_totals(spark, sf):
    return V.request_totals(X.rpc(spark, sf))


@query
def request_totals_by_instance(spark, sf):
    return V.request_totals(X.rpc(spark, sf), ["instance"])


@query
def latency_histogram(spark, sf):
    return V.latency_histogram(X.rpc(spark, sf)).withColumn("duration_sum", F.col("duration_sum").cast("string"))


# --- streams: run over the table to its end, then read back what was written -----------

def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = X.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _drain(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    out = work_path(spark, name)
    running = (df.writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", work_path(spark, f"{name}-checkpoint"))
               .outputMode("append").trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query
def stream_hang(spark, sf):
    found = _drain(stream_hang_detection(X.log_lines_of(_stream(spark, sf, "events")), "0 seconds", 7200), "hang")
    return found.select("node", "rank", FT.format_rfc3339("last_line").alias("last_line"), "lines")


@query
def stream_hang_batches(spark, sf):
    """Four mixed batches, ranks that are expected, and a beat that closes the last silences."""
    lines = X.log_lines_of(X.batches(spark, sf, "events", 4, work_path(spark, "events")))
    beat = X.closing_beat(spark, sf, "events", 90, work_path(spark, "beat"), 4)
    found = _drain(stream_hang_detection(lines, "70 days", 7200, beat, X.expected_ranks(spark, sf, work_path(spark, "expected"))), "hang")
    return found.select("node", "rank", FT.format_rfc3339("last_line").alias("last_line"), "lines")


@query
def stream_alerts(spark, sf):
    found = _drain(SA.stream_alerts(X.event_store_of(_stream(spark, sf, "events")), 1), "alerts")
    return found.select("id", "node", "timestamp", "severity")


@query
def stream_ingest(spark, sf):
    raw = _stream(spark, sf, "events").select("event_id", F.concat(
        F.lit('{"msg_type":"text","content":{"text":"'), "event_type",
        F.when(F.col("event_type") == "error", "").otherwise('"'), F.lit("}}")).alias("body"))
    events = SA.stream_event_ingest(raw, "body", X.AS_OF_MS, ["event_id"])
    out = work_path(spark, "ingest")
    SA.write_event_stream(events, out, work_path(spark, "ingest-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return read_event_store(spark, out).select("id", "source", "type", "message", "timestamp", "processed")


@query
def stream_mark_processed(spark, sf):
    delivered = SA.stream_alerts(X.event_store_of(_stream(spark, sf, "events")), 1)
    out = work_path(spark, "ledger")
    SA.write_marks(delivered, out, work_path(spark, "ledger-checkpoint"), X.AS_OF_MS, "a").trigger(availableNow=True).start().awaitTermination()
    marks = spark.read.schema(LEDGER_SCHEMA).parquet(out)
    return E.apply_processed(X.event_store(spark, sf), marks).select("id", "processed", "processed_at")


@query
def stream_metrics(spark, sf):
    beat = X.closing_beat(spark, sf, "lineitem", 2, work_path(spark, "beat"))
    found = _drain(stream_request_metrics(X.rpc_of(_stream(spark, sf, "lineitem")), "0 seconds", "1 day", beat), "metrics")
    return running_totals(found).select(FT.format_rfc3339("start").alias("start"), "method", "status", "requests", "total")


@query
def stream_alerts_ledger(spark, sf):
    """Two streams, one after the other, over four mixed batches each; the second tells what the first did not."""
    ledger, out = work_path(spark, "ledger"), work_path(spark, "told")
    for name, severity in (("a", 2), ("b", 1)):
        def deliver(alerts: DataFrame, batch_id: int, name: str = name) -> None:
            alerts.write.mode("overwrite").parquet(f"{out}/told_by={name}/batch={batch_id}")

        events = X.event_store_of(X.batches(spark, sf, "events", 4, work_path(spark, "events")))
        (G.deliver_alerts(events, ledger, work_path(spark, "cp"), name, X.AS_OF_MS, deliver, severity, loose=3)
         .trigger(availableNow=True).start().awaitTermination())
    told = spark.read.schema("id string, timestamp bigint, severity int, node string, message string, told_by string, batch int").parquet(out)
    return told.join(G.read_ledger(spark, ledger).select("id", "processed", "processed_at"), "id").select(
        "id", "node", "timestamp", "severity", "told_by", "processed", "processed_at")


@query
def stream_ingest_rejects(spark, sf):
    """Accepted and rejected payloads of four batches, with the time of their message."""
    raw = X.batches(spark, sf, "events", 4, work_path(spark, "events")).select("event_id", X.as_utc("ts").alias("at"), F.concat(
        F.lit('{"MSG_TYPE":"text","Content":{"text":"first","Text":"'), "event_type", F.when(F.col("event_type") == "error", "").otherwise('"'), F.lit("}}")).alias("body"))
    store, rejects = work_path(spark, "ingest"), work_path(spark, "rejects")
    (SA.write_ingest(raw, "body", ["event_id"], F.unix_millis("at"), store, rejects, work_path(spark, "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    good = read_event_store(spark, store).select("id", "timestamp", "message")
    return good.unionByName(spark.read.parquet(rejects).select("id", "timestamp", F.concat(F.lit("bad "), "payload").alias("message")))
