"""Expressions over stack dumps and processes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trainscope.functions.logs import _lookup
from trainscope.functions.text import _c, digits_to_bigint, trim_rest, trim_space, wrap_int32
from trainscope.schemas import (
    FRAME_LANGUAGE, FRAME_START, PROCESS_KINDS, PROCESS_TYPES, THREAD_HEADER, THREAD_START,
)


def process_type(kind: Column | str) -> Column:
    return F.coalesce(_lookup(_c(kind), PROCESS_KINDS), F.lit(0))


def process_type_name(code: Column | str) -> Column:
    number = _c(code)
    named = F.coalesce(*[F.when(number == v, F.lit(k)) for k, v in PROCESS_TYPES.items()])
    return F.coalesce(named, number.cast("string"))


def parse_thread_header(line: Column | str) -> Column:
    """``struct<thread_id, thread_name>``; -1 and ``unknown`` for another shape."""
    text = _c(line)
    digits = F.regexp_extract(text, THREAD_HEADER, 1)
    return F.struct(
        F.coalesce(wrap_int32(digits_to_bigint(digits)), F.lit(-1)).alias("thread_id"),
        F.when(digits != "", F.regexp_extract(text, THREAD_HEADER, 2)).otherwise(F.lit("unknown")).alias("thread_name"),
    )


def _drop_language(line: Column) -> Column:
    """Without the first language mark of a line that has one."""
    return F.overlay(line, F.lit(""), F.instr(line, FRAME_LANGUAGE), F.lit(len(FRAME_LANGUAGE)))


def clean_frame(line: Column | str) -> Column:
    """Drop the first language mark and the outer white space."""
    text = _c(line)
    return trim_space(F.when(F.contains(text, F.lit(FRAME_LANGUAGE)), _drop_language(text)).otherwise(text))


def parse_stack_dump(dump: Column | str) -> Column:
    """Threads of one dump as an array, inside the row: no explode and no shuffle.

    The dump is cut before each thread header.  Inside a piece each frame line
    becomes an empty line and its text, each code line its text, and the rest
    nothing; joined and cut at the empty lines, this gives the frames with their
    code.  Every step is one pass, so the work is linear in the dump's length.
    """
    raw = _c(dump)
    text = F.when(F.contains(raw, F.lit("\r")), F.regexp_replace(raw, r"\r(?=\n|\z)", "")).otherwise(raw)
    sections = F.filter(F.split(text, rf"\n(?={THREAD_START})"), lambda s: s.startswith(THREAD_START))

    def wanted(line: Column, i: Column) -> Column:
        # One result, trimmed of blanks; the rest of the trimming sees it once.
        is_frame = F.contains(line, F.lit(FRAME_START))
        is_code = line.startswith("    ") & ~F.contains(line, F.lit("File"))
        return F.trim(F.when(i == 0, F.lit("")).when(is_frame, _drop_language(line))
                      .when(is_code, line).otherwise(F.lit("")))

    def placed(trimmed: Column) -> Column:
        # Of the wanted lines only frames have the word in them.
        return (F.when(F.contains(trimmed, F.lit("File")), F.concat(F.lit("\n\n"), trimmed))
                .when(trimmed != "", F.concat(F.lit("\n"), trimmed)).otherwise(F.lit("")))

    def thread(section: Column) -> Column:
        header = parse_thread_header(F.substring_index(section, "\n", 1))
        body = F.array_join(F.transform(F.transform(F.transform(F.split(section, "\n"), wanted), trim_rest), placed), "")
        # What comes before the first empty line is code without a frame.
        frames = F.slice(F.split(body, "\n\n"), F.lit(2), F.lit(2**31 - 2))
        return F.struct(header["thread_id"].alias("thread_id"), header["thread_name"].alias("thread_name"),
                        frames.alias("stack_frames"))

    return F.transform(sections, thread)
