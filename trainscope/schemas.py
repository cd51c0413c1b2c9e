"""Schemas and the fixed values shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: enum numbers and names ----------------------------------
LOG_LEVELS = {
    "LOG_UNSPECIFIED": 0,
    "LOG_DEBUG": 1,
    "LOG_INFO": 2,
    "LOG_WARNING": 3,
    "LOG_ERROR": 4,
    "LOG_CRITICAL": 5,
}
PROCESS_TYPES = {
    "PROCESS_UNSPECIFIED": 0,
    "PROCESS_TRAINER": 1,
    "PROCESS_DATA_LOADER": 2,
    "PROCESS_LAUNCHER": 3,
}
PROCESS_KINDS = {"trainer": 1, "dataloader": 2}
SEVERITIES = {"INFO": 0, "WARNING": 1, "ERROR": 2, "CRITICAL": 3}

# --- Fixed values: defaults and limits --------------------------------------
DEFAULT_TAIL_LINES = 30
DEFAULT_HANG_SECONDS = 120
MAX_LINE_BYTES = 1024 * 1024
NO_TIME_SECONDS = -10
EARLIEST_VALID_TIME = "2000-01-01T00:00:00Z"
# Samples of a check follow each other within a pause and two time limits; the next check starts a minute later or more.
CHECK_GAP_SECONDS = 50
DEFAULT_EVENT_TYPE = "alert"
WEBHOOK_SOURCE = "trainning"
METRICS_INTERVAL = "15 seconds"
LATENCY_BUCKETS = ("0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10")

# --- Fixed values: text patterns ---------------------------------------------
# Name, rank, time and level of a log line; the message body follows.
LOG_HEAD = r"\[[^\]]+\]\[RANK \d+\]\[[^\]]+\]\[[^\]]+\] "
LOG_EPOCH = r"\[Train\] \(Epoch (\d+)\)"
# Date, time and fraction; any other text matches with all groups empty.
LOG_TIME = r"(?s)\A(?:(\d{4}-\d\d-\d\d) +(\d{1,2}:\d\d:\d\d)(?:[.,](\d+))?|.*)\z"
THREAD_START = "Traceback for thread"
# Every character of the Unicode White_Space property.
WHITE_SPACE = ("\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
THREAD_HEADER = r"(?s)Traceback for thread (\d+) \((.*?)\)"
FRAME_LANGUAGE = "(Python) "
FRAME_START = "(Python) File"
NODE_LIST = r"nodes=\[([^\]]*?)\]"
RANK_FILE = r"/rank(\d+)\.log$"

# --- Schemas --------------------------------------------------------------
EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("metadata", T.VariantType()),
    T.StructField("processed", T.BooleanType()),
    T.StructField("processed_at", T.LongType()),
])
LEDGER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("processed", T.BooleanType()),
    T.StructField("processed_at", T.LongType()),
    T.StructField("seq", T.LongType()),
])
