"""The last lines of rank logs, read from the ends of the files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainscope.functions.text import rank_label
from trainscope.operators.logs import latest_run_dir
from trainscope.schemas import DEFAULT_TAIL_LINES, RANK_FILE

#: Bytes of the first block read from the end of a file; each block before it is twice as long.
BLOCK = 1 << 15

_TAIL = "path string, place int, offset long, line string, error string"


def list_log_files(spark: SparkSession, work_dir: str | list[str]) -> DataFrame:
    """``work_dir, run, path, rank_no, rank, length, file_mtime`` of every ``rank<N>.log``; no file is opened.

    ``run`` is the folder that holds the file, ``work_dir`` the one above it.  Files without a byte are not listed.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "rank*.log").option("recursiveFileLookup", "true").load(work_dir)
             .select("path", F.col("modificationTime").alias("file_mtime"), "length"))
    number = F.regexp_extract("path", RANK_FILE, 1)
    run = F.regexp_replace("path", r"/[^/]*\z", "")
    return (files.withColumn("rank_no", F.when(number != "", number).try_cast("int")).filter("rank_no is not null")
            .select(F.regexp_replace(run, r"/[^/]*\z", "").alias("work_dir"), run.alias("run"), "path", "rank_no", rank_label("rank_no").alias("rank"),
                    "length", "file_mtime"))


def newest_run_files(files: DataFrame) -> DataFrame:
    """The files of the newest run of each work directory; a run is as new as its newest file."""
    runs = files.groupBy("work_dir", "run").agg(F.max("file_mtime").alias("mtime"))
    newest = latest_run_dir(runs.select("work_dir", F.col("run").alias("path"), "mtime", F.lit(True).alias("is_dir")))
    return files.join(newest.select("work_dir", F.col("path").alias("run")), ["work_dir", "run"], "left_semi")


def _lines_from_end(source, length: int, n: int, block: int) -> list[tuple[int, bytes]]:
    """Offset and bytes of the last ``n`` lines, from as many blocks as hold them."""
    at, pieces, breaks = length, [], 0
    while at and breaks <= n:  # one more break than lines: the last line may end with one
        step = min(block, at)
        at, block = at - step, 2 * block
        source.seek(at)
        pieces.append(source.read(step))
        breaks += pieces[-1].count(b"\n")
    lines = b"".join(reversed(pieces)).split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    out = []
    for line in lines:
        out.append((at, line))
        at += len(line) + 1
    return out[-n:]


def _read(paths: list[str], lengths: list[int], n: int, block: int) -> Iterator[dict]:
    for path, length in zip(paths, lengths):
        try:
            system, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "/", path))
            with system.open_input_file(inner) as source:
                found = _lines_from_end(source, min(length, source.size()), n, block)
        except OSError as problem:
            yield {"path": path, "place": 0, "offset": 0, "line": None, "error": os.strerror(problem.errno) if problem.errno else str(problem)}
            continue
        for place, (offset, line) in enumerate(found):
            text = line.decode("utf-8", "replace")
            yield {"path": path, "place": place, "offset": offset, "line": text.removesuffix("\r"), "error": None}


def read_tails(files: DataFrame, n: int = DEFAULT_TAIL_LINES, node: Column | str | None = None, block: int = BLOCK) -> DataFrame:
    """Last ``n`` lines of each of ``files(path, length, rank_no, rank, file_mtime)``, in the form of ``read_rank_logs``.

    A file is read backwards in blocks until its last ``n`` lines are in them, so the bytes read follow the lines
    asked for and not the length of the file.  ``line_no`` is the line's offset.  A file that cannot be read
    gives one row with ``error`` and no line, and the others still load; bytes that are no UTF-8 are replaced.
    The file systems are those of pyarrow.  ``node`` is a name, or an expression over ``path`` and ``rank_no``.
    """
    if n <= 0:
        raise ValueError("the number of lines must be positive")

    def read(batches):
        for batch in batches:
            rows = []
            for row in _read(batch.column("path").to_pylist(), batch.column("length").to_pylist(), n, block):
                rows.append(row)
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("place", pa.int32()), ("offset", pa.int64()), ("line", pa.string()), ("error", pa.string())])
    # A file costs about the same whatever its length, so files are dealt out evenly.
    tails = files.select("path", "length").repartition(F.xxhash64("path")).mapInArrow(read, _TAIL)
    name = F.lit(node) if isinstance(node, str) or node is None else node
    return (tails.join(files.select("path", "rank_no", "rank", "file_mtime"), "path")
            .select(name.cast("string").alias("node"), "rank_no", "rank", "line", F.col("offset").alias("line_no"), "path", "file_mtime", "error"))


def split_failed(tails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that were read, and ``node, rank_no, reason`` of files that were not, for ``complete_ranks``."""
    return tails.filter("error is null").drop("error"), tails.filter("error is not null").select("node", "rank_no", F.col("error").alias("reason"))
