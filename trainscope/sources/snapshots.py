"""Saved process stack snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainscope.functions.logs import _lookup
from trainscope.schemas import CHECK_GAP_SECONDS, PROCESS_TYPES
from trainscope.session import stored

# Both spellings of each key: camel case with type names, snake case with numbers.
_THREAD = ("struct<thread_id:int,threadId:int,thread_name:string,threadName:string,"
           "stack_frames:array<string>,stackFrames:array<string>>")
_PROCESS_FIELDS = (f"pid:int,ppid:int,type:string,threads:array<{_THREAD}>,rank:string,"
                   "local_rank:string,localRank:string")
_PROCESS = f"struct<{_PROCESS_FIELDS}>"
# A document is a sample, a list of samples, or one process of a sample that names the sample itself.
_DOCUMENT = (f"struct<processes:array<{_PROCESS}>,lists:array<array<{_PROCESS}>>,{_PROCESS_FIELDS},node_name:string,check_id:string,"
             "snapshot_no:int,snapshot_time:string,_corrupt_record:string>")
# The name of a file, or of a folder above it: node, then day, time, and the verdict that all but the first sample of a check have.
_NAME, _BETWEEN = r"[/=]node([^/]*_processInfo_[^/]*)", "_processInfo_"
_DAY, _CLOCK = r"\A(\d{4}-\d\d-\d\d)_\d\d-\d\d-\d\d", r"\A\d{4}-\d\d-\d\d_(\d\d-\d\d-\d\d)"
_TIME = r"\A(?:\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d)?"
#: Bytes of whole documents, or of one long document, that a row holds; bytes read at once.
PART, READ = 1 << 19, 1 << 21
# Documents end at blank lines.  They may also follow each other without one: between the end of one and the start of the next is no comma.
_BLANK, _NEXT = r"\n\n+", r"(?<=[}\]])\s*\n\s*(?=[{\[])"
_BREAK = re.compile(f"{_BLANK}|{_NEXT}".encode())
_STRING = re.compile(rb"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'", re.DOTALL)
_LIST = re.compile(rb"[\"']processes[\"']\s*:\s*\Z")
# Packed files cannot be read from the middle.
_PACKED = r"\.(gz|bz2|lz4|zst)$"
_PIECES = "path string, block long, row long, fresh boolean, part int, base int, opening string, closing string, text binary"


class Snapshots(NamedTuple):
    """What saved snapshot files hold."""

    processes: DataFrame  # node, path, check_id, snapshot_no, snapshot_time and the process
    samples: DataFrame  # node, path, check_id, snapshot_no, snapshot_time, n_processes: every sample taken, empty ones too
    rejects: DataFrame  # node, path, snapshot_time, part, content: documents that cannot be read, or only in part; long ones in parts from 0


def _threads(threads: Column) -> Column:
    return F.transform(F.coalesce(threads, F.array().cast(f"array<{_THREAD}>")), lambda t: F.struct(
        F.coalesce(t["thread_id"], t["threadId"], F.lit(0)).alias("thread_id"),
        F.coalesce(t["thread_name"], t["threadName"], F.lit("")).alias("thread_name"),
        F.coalesce(t["stack_frames"], t["stackFrames"], F.array().cast("array<string>")).alias("stack_frames")))


def _process_columns(p: str) -> list[Column]:
    code = F.coalesce(_lookup(F.col(f"{p}.type"), PROCESS_TYPES), F.col(f"{p}.type").try_cast("int"), F.lit(0))
    return [
        F.coalesce(f"{p}.pid", F.lit(0)).alias("pid"), F.coalesce(f"{p}.ppid", F.lit(0)).alias("ppid"),
        code.alias("type"), _threads(F.col(f"{p}.threads")).alias("threads"),
        F.coalesce(f"{p}.rank", F.lit("")).alias("rank"),
        F.coalesce(f"{p}.local_rank", f"{p}.localRank", F.lit("")).alias("local_rank")]


class _Reader:
    """Bytes of a file as they are wanted: ``held`` begins at offset ``at``."""

    def __init__(self, source, at: int):
        self.source, self.at, self.held, self.ended = source, at, b"", False

    def more(self) -> None:
        fresh = self.source.read(READ)
        self.held, self.ended = self.held + fresh, not fresh

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _outside_strings(text: bytes) -> tuple[np.ndarray, int]:
    """The bytes with those of strings blotted out, and where a string begins that has no end yet, or -1."""
    x = np.frombuffer(text.replace(rb"\\", b"__").replace(rb"\"", b"__"), np.uint8)
    quote = x == 34
    quotes = np.flatnonzero(quote)
    cut = int(quotes[-1]) if len(quotes) % 2 else -1
    within = quote | (np.cumsum(quote, dtype=np.uint8) & 1 == 1)
    if cut >= 0:
        within[cut:] = False
    x = np.where(within, np.uint8(95), x)
    if (x == 39).any():  # a string in single quotes, in which others do not count
        bare = _STRING.sub(lambda m: b"_" * (m.end() - m.start()), text)
        cut = min((q for q in (bare.find(b'"'), bare.find(b"'")) if q >= 0), default=-1)
        x = np.frombuffer(bare, np.uint8)
    return x, cut


def _long_document(file: _Reader) -> Iterator[tuple[int, int, str, str, bytes]]:
    """One document in pieces cut between its processes: part, samples before it, what makes it whole JSON, and its bytes.

    Brackets are counted outside strings, so nothing of the document is held but the piece at hand.  A list of
    processes is cut at its commas, no other list is.  The document is left when its end is reached.
    """
    seen = depth = part = base = lists = 0
    opening, inside, is_list = "", False, file.held.lstrip()[:1] == b"["
    while True:
        # White space at the end of what was seen may belong to the end of the document.
        from_here = max(len(file.held[:seen].rstrip()) - 1, 0)
        found = _BREAK.search(file.held, from_here) if file.held.find(b"\n", from_here) >= 0 else None
        end = found.start() if found else len(file.held)
        ended = file.ended or found is not None
        x, cut_string = _outside_strings(file.held[seen:end])
        if cut_string >= 0 and not ended:
            x = x[:cut_string]  # the string goes on: look at it again when more is read
        up, down = (x == 123) | (x == 91), (x == 125) | (x == 93)
        level = depth + np.cumsum(up.astype(np.int64) - down)
        opened = np.flatnonzero(up & (level == 2))
        cuttable = np.array([inside, *(x[i] == 91 and (is_list or _LIST.search(file.held, max(seen + i - 80, 0), seen + i) is not None) for i in opened)])
        commas = np.flatnonzero((x == 44) & ((level == 2) | ((level == 1) & is_list)))
        owner = np.searchsorted(opened, commas)
        use = cuttable[owner] | (level[commas] == 1)
        commas, owner = commas[use], owner[use]
        start = 0
        while len(commas):
            k = np.searchsorted(commas, start + PART - seen)
            if k == len(commas):
                break
            deep, stop = level[commas[k]] == 2, seen + int(commas[k]) + 1
            close, again = ("]]", "[[") if deep and is_list else ("]", "[") if is_list else ("]}", '{"processes":[')
            yield part, base, opening, close, file.held[start:stop]
            part, opening, start = part + 1, again, stop
            base = lists + int(owner[k]) - (1 if deep else 0) if is_list else 0
            if file.held[start:end].lstrip()[:1] in (b"]", b",", b"}"):
                opening += ","  # no process follows the comma, which is no JSON and stays none
        if len(x):
            lists, depth, inside = lists + len(opened), int(level[-1]), bool(cuttable[-1])
        seen += len(x) - start
        file.drop(start)
        if ended:
            yield part, base, opening, "", file.held[:end - start]
            file.drop(end - start)
            return
        file.more()


def _read_range(source, start: int, stop: int) -> Iterator[tuple]:
    """``row, fresh, part, base, opening, closing, text`` of the documents that begin after ``start`` and up to ``stop``.

    Documents go together as they stand, with part -1, in at most twice ``READ`` bytes; one longer than that is cut.
    """
    file = _Reader(source, max(start - 1, 0))
    if start:
        source.seek(start - 1)
        while True:
            blank = re.search(_BLANK.encode(), file.held)
            if blank and (blank.end() < len(file.held) or file.ended):
                file.drop(blank.end())
                break
            if file.ended or file.at > stop:
                return
            file.drop(blank.start() if blank else max(len(file.held) - 1, 0))
            file.more()
    fresh = True
    while True:
        while len(file.held) < READ and not file.ended:
            file.more()
        if fresh:
            file.drop(len(file.held) - len(file.held.lstrip(b"\n")) if file.at else 0)
        if not file.held or (fresh and file.at > stop):
            return
        over = stop - file.at
        last = re.compile(_BLANK.encode()).search(file.held, max(over - 1, 0)) if len(file.held) > over else None
        end = last.start() if last else len(file.held) if file.ended else file.held.rfind(b"\n\n")
        now, whole = fresh, True
        if end < 0:  # no blank line in sight
            breaks = [m.end() for m in _BREAK.finditer(file.held)] if b"\n" in file.held else []
            end, whole = (breaks[-1], False) if breaks else (-1, True)
        if end < 0:
            row = file.at
            for piece in _long_document(file):
                yield row, now, *piece
            end_of_lines = len(file.held) - len(file.held.lstrip())
            fresh = file.held[:end_of_lines].count(b"\n") != 1 and b"\n\n" in file.held[:end_of_lines]
            continue
        for at, text in _lots(file.held[:end]):
            yield file.at + at, now or at > 0, -1, 0, "", "", text
        file.drop(end)
        fresh = whole
        if last:
            return


def _lots(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Offsets and bytes of runs of whole documents, cut at blank lines about every ``PART`` bytes."""
    at = 0
    while at < len(text):
        blank = text.find(b"\n\n", at + PART)
        end = blank if blank >= 0 else len(text)
        yield at, text[at:end]
        at = end + len(text[end:end + READ]) - len(text[end:end + READ].lstrip(b"\n"))


def _pieces_of(files: DataFrame) -> DataFrame:
    """The text of ``files(path, length, name)`` in rows of bounded size, by ranges of files that begin at blank lines."""
    spark = files.sparkSession
    size = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("fresh", pa.bool_()), ("part", pa.int32()),
                        ("base", pa.int32()), ("opening", pa.string()), ("closing", pa.string()), ("text", pa.binary())])

    def read(batches):
        for batch in batches:
            for path, name, block, length in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "block", "length"))):
                system, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "/", path))
                packed = re.search(_PACKED, path) is not None
                with (system.open_input_stream(inner) if packed else system.open_input_file(inner)) as source:
                    rows, held = [], 0
                    for row in _read_range(source, block, 1 << 62 if packed else min(block + size, length)):
                        rows.append((name, block, *row))
                        held += len(row[-1])
                        if held > READ:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    last = F.when(F.col("path").rlike(_PACKED), 0).otherwise(F.greatest(F.col("length") - 1, F.lit(0)))
    ranges = files.select("path", "name", "length", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(size).cast("long"))).alias("block"))
    # A number given here keeps adaptive execution from putting the short rows of many long files into one task.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, F.xxhash64("path", "block")).mapInArrow(read, _PIECES)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("_metadata.file_path").alias("name"))


def _documents(files: DataFrame) -> DataFrame:
    """One row a document, or a piece of a long one.  Files are cut at blank lines where they lie, so a long file is read by many tasks."""
    # What the path says is looked up once a piece, not once a document.
    told = ["node", "day", "clock", "suffix"]
    pieces = (_pieces_of(files).withColumn("text", F.col("text").cast("string"))
              .withColumn("name", F.when(F.contains("path", F.lit(_BETWEEN)), F.regexp_extract("path", _NAME, 1)).otherwise(""))
              .withColumn("rest", F.substring(F.col("name"), F.instr("name", _BETWEEN) + len(_BETWEEN), F.length("name")))
              .withColumns({"node": F.nullif(F.substring_index("name", _BETWEEN, 1), F.lit("")), "day": F.regexp_extract("rest", _DAY, 1),
                            "clock": F.translate(F.regexp_extract("rest", _CLOCK, 1), "-", ":"), "suffix": F.regexp_replace("rest", _TIME, "")}))
    cut = F.col("part") >= 0
    blocks = pieces.select("path", *told, "block", "row", "fresh", "part", "base", "opening", "closing",
                           F.posexplode(F.when(cut, F.array("text")).otherwise(F.split("text", _BLANK))).alias("no", "value"))
    place = F.struct("block", "row", "no")
    one_line = ~F.contains("value", F.lit("\n"))
    docs = blocks.select("path", *told, place.alias("at"), (F.col("fresh") | (F.col("no") > 0)).alias("fresh"), "part", "base", "opening", "closing",
                         F.posexplode(F.when(cut, F.array("value")).when(one_line, F.array(F.trim("value")))
                                      .otherwise(F.split(F.trim("value"), _NEXT))).alias("doc_no", "text"))
    docs = docs.withColumn("text", F.when(cut, F.col("text")).otherwise(F.btrim("text", F.lit(" \r\n\t"))))
    return docs.filter("text <> ''")


def _parsed(docs: DataFrame) -> DataFrame:
    """With ``d``, the document or its piece as columns."""
    within = F.when(F.col("closing") == "", F.col("text")).otherwise(F.expr("left(text, length(text) - 1)"))
    body = F.when(F.col("part") < 0, F.col("text")).otherwise(F.concat("opening", within, "closing"))
    docs = docs.withColumn("text_or_piece", body)
    is_list = F.ltrim("text_or_piece").startswith("[")
    wrapped = F.when(is_list, F.concat(F.lit('{"lists":'), "text_or_piece", F.lit("}"))).otherwise(F.col("text_or_piece"))
    return docs.withColumn("d", F.from_json(wrapped, _DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt_record"}))


def _numbered(samples: DataFrame, gap_seconds: int) -> DataFrame:
    """Adds ``check_id`` and ``snapshot_no`` to ``samples(node, path, snapshot_time, first, place...)``.

    A node's samples in order of time; a check begins with a file that has no verdict in its name, and
    after a pause of more than ``gap_seconds``.  The order is followed day by day: of each day only its last
    sample and its last beginning are handed on, so no task sorts all samples of a node.
    """
    order = ["snapshot_time", "path", "at", "doc_no", "sample_no"]
    who = samples.withColumn("_who", F.coalesce("node", "path")).withColumn("_day", F.substring("snapshot_time", 1, 10))
    seconds = F.unix_timestamp(F.expr("try_to_timestamp(nullif(snapshot_time, ''))"))
    who = who.withColumn("_s", seconds)
    days = who.groupBy("_who", "_day").agg(F.max("_s").alias("_last"))
    earlier = Window.partitionBy("_who").orderBy("_day")
    before = days.select("_who", "_day", F.lag("_last").over(earlier).alias("_before"))
    in_day = Window.partitionBy("_who", "_day").orderBy(*order)
    pause = F.col("_s") - F.coalesce(F.lag("_s").over(in_day), F.col("_before"))
    begins = F.col("first") | (pause > gap_seconds)
    # The first sample of a node begins a check in any case: there is none before it.
    marked = who.join(before, ["_who", "_day"]).withColumn("_pause", pause).withColumn("_start", F.when(F.coalesce(begins, F.lit(False)), F.struct(*order)))
    last = marked.groupBy("_who", "_day").agg(F.max("_start").alias("_end"), F.min(F.struct(*order)).alias("_first"))
    so_far = earlier.rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select("_who", "_day", F.last("_end", ignorenulls=True).over(so_far).alias("_handed"),
                         F.min("_first").over(Window.partitionBy("_who")).alias("_very_first"))
    here = F.last("_start", ignorenulls=True).over(in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.coalesce(F.col("_here"), F.col("_handed"), F.col("_very_first"))
    told = marked.withColumn("_here", here).join(handed, ["_who", "_day"]).withColumn("_from", start)
    name = F.coalesce(F.nullif(F.col("_from.snapshot_time"), F.lit("")), F.col("_from.path"))
    number = F.row_number().over(Window.partitionBy("_who", "_from").orderBy(*order)) - 1
    return told.withColumn("check_id", name).withColumn("snapshot_no", number)


def read_snapshots(spark: SparkSession, path: str, gap_seconds: int = CHECK_GAP_SECONDS) -> Snapshots:
    """Processes, samples and rejects of saved snapshot files, in either spelling.

    A file holds JSON documents, appended: objects with a list of processes, an object without one being an
    empty sample; a list of such lists; or the records that ``write_process_snapshots`` writes, which name
    their sample themselves.  Other samples have their node and ``snapshot_time`` from the name of the file or of a
    folder above it (``node<node>_processInfo_<time>``); a file whose name has no node is a check by itself.

    ``check_id`` is the time of a check's first sample, and ``snapshot_no`` counts its samples by time, then by place in
    the file.  A blank line inside a document cuts it, which makes it a reject.  The documents are parsed
    once and stored process by process, so that samples and processes read columns and not text.  A document of
    more than twice ``READ`` bytes is parsed in pieces of some of its processes; if one of them is bad, all of it is a reject.
    """
    files = _files(spark, path)
    docs = _parsed(_documents(files))
    single = F.col("d.node_name").isNotNull()
    bad = F.col("d._corrupt_record").isNotNull() | F.col("d").isNull()
    none = F.array().cast(f"array<{_PROCESS}>")
    whole = F.when(F.col("d.lists").isNotNull(), F.col("d.lists")).otherwise(F.array(F.coalesce("d.processes", none)))
    own = F.when(F.col("d.pid").isNull(), none).otherwise(F.array(F.struct(
        *(F.col(f"d.{f.split(':')[0]}") for f in ("pid", "ppid", "type", "threads", "rank", "local_rank", "localRank")))))
    samples = F.when(bad, F.array().cast(f"array<array<{_PROCESS}>>")).when(single, F.array(own)).otherwise(whole)
    time = F.trim(F.concat_ws(" ", "day", "clock"))
    parsed = docs.select(
        "path", "at", "doc_no", "part", "base", F.coalesce(F.when(single, F.col("d.node_name")), F.col("node")).alias("node"),
        F.when(single, F.col("d.snapshot_time")).otherwise(time).alias("snapshot_time"),
        F.when(single, F.struct(F.col("d.check_id").alias("check_id"), F.col("d.snapshot_no").alias("snapshot_no"))).alias("told"),
        ((F.regexp_replace("suffix", r"\.json\z", "") == "") & F.col("fresh") & (F.col("doc_no") == 0) & (F.col("at.block") == 0)).alias("first_document"),
        bad.alias("bad"), F.when(bad & (F.col("part") < 0), F.col("text")).alias("content"), F.posexplode_outer(samples).alias("place", "list"))
    kept = [c for c in parsed.columns if c not in ("base", "place", "list")]
    parsed = stored(parsed.select(*kept, (F.col("place") + F.col("base")).alias("sample_no"), F.size("list").alias("size"),
                                  F.posexplode_outer("list").alias("process_no", "p")), "snapshots")
    document, place = ["path", "at", "doc_no"], ["path", "at", "doc_no", "sample_no"]
    broken = parsed.filter("bad and part >= 0").select(*document).distinct()
    facts = (parsed.filter("told is null and sample_no is not null and coalesce(process_no, 0) = 0").join(broken, document, "left_anti")
             .groupBy(*place, "node", "snapshot_time").agg(F.max("first_document").alias("first_document"), F.sum("size").cast("int").alias("n_processes")))
    # Only the first document of a file can begin a check by its name; others were appended in the same second.
    opening = facts.filter("first_document and sample_no = 0 and node is not null").groupBy("path").agg(F.min("at").alias("at"))
    facts = facts.join(opening.withColumn("opens", F.lit(True)), ["path", "at"], "left").withColumn(
        "first", F.coalesce("opens", F.lit(False)) & F.col("first_document") & (F.col("sample_no") == 0))
    numbered = stored(_numbered(facts, gap_seconds).select(
        "node", *place, "check_id", "snapshot_no", "snapshot_time", "n_processes"), "samples")
    rows = (parsed.filter("told is null and process_no is not null").select(*place, "p")
            .join(numbered.select(*place, "node", "check_id", "snapshot_no", "snapshot_time"), place))
    records = parsed.filter("told is not null").select("path", "node", "told.check_id", "told.snapshot_no", "snapshot_time",
                                                       "process_no", "p", F.col("size").alias("n_processes"))
    head = ["node", "path", "check_id", "snapshot_no", "snapshot_time"]
    processes = rows.select(*head, "p").unionByName(records.filter("process_no is not null").select(*head, "p")).select(*head, *_process_columns("p"))
    # The records of a sample lie in several files, so it has the first of them for path.
    taken = numbered.select(*head, "n_processes").unionByName(
        records.groupBy("node", "check_id", "snapshot_no").agg(F.min("path").alias("path"), F.max("snapshot_time").alias("snapshot_time"),
                                                                F.sum("n_processes").cast("int").alias("n_processes")).select(*head, "n_processes"))
    # The text of a long document is read again, and only if the document is bad.
    long = _documents(files.join(broken.select(F.col("path").alias("name")).distinct(), "name", "left_semi")).filter("part >= 0")
    long = long.join(broken, document, "left_semi").select("node", "path", time.alias("snapshot_time"), "part", F.col("text").alias("content"))
    short = parsed.filter("content is not null").select("node", "path", "snapshot_time", F.lit(0).alias("part"), "content")
    return Snapshots(processes, taken, short.unionByName(long))


def read_process_snapshots(spark: SparkSession, path: str, gap_seconds: int = CHECK_GAP_SECONDS) -> DataFrame:
    """The processes of ``read_snapshots``."""
    return read_snapshots(spark, path, gap_seconds).processes
