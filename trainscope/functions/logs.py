"""Expressions over one log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trainscope.functions.text import _c, digits_to_bigint, parse_log_time, wrap_int32
from trainscope.schemas import LOG_EPOCH, LOG_HEAD, LOG_LEVELS


def _lookup(value: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def parse_level(value: Column | str, accept_short: bool = False) -> Column:
    """Level number.  Only full names such as ``LOG_INFO`` count unless ``accept_short``."""
    table = dict(LOG_LEVELS)
    if accept_short:
        table |= {name.removeprefix("LOG_"): code for name, code in LOG_LEVELS.items()}
    return F.coalesce(_lookup(_c(value), table), F.lit(0))


def parse_epoch(body: Column | str) -> Column:
    """Epoch number of a training step; 0 when the text names none."""
    digits = F.regexp_extract(_c(body), LOG_EPOCH, 1)
    # A number beyond 64 bits saturates, and its low 32 bits are then -1.
    number = F.coalesce(digits_to_bigint(digits), F.lit(-1).cast("bigint"))
    return F.when(digits == "", F.lit(0)).otherwise(wrap_int32(number))


def line_head(line: Column | str) -> Column:
    """``[name][RANK n][time][level] `` of a line; '' for a line of another shape."""
    return F.regexp_extract(_c(line), LOG_HEAD, 0)


def _head_part(head: Column, n: int) -> Column:
    # The parts of a head hold no ']', so they are cut out by position.
    return F.substr(F.substring_index(F.substring_index(head, "]", n), "]", -1), F.lit(2))


def entry_fields(line: Column, head: Column, zone: str | None = None, accept_short: bool = False) -> dict[str, Column]:
    """``ts, level, epoch, message``; for another shape only the message is set."""
    body = F.substring(line, F.instr(line, head) + F.length(head), F.length(line))
    return {
        "ts": parse_log_time(_head_part(head, 3), zone),
        "level": parse_level(_head_part(head, 4), accept_short),
        "epoch": parse_epoch(F.when(head != "", body).otherwise("")),
        "message": line,
    }


def log_entry(line: Column | str, zone: str | None = None, accept_short: bool = False) -> Column:
    """``struct<kept, ts, level, epoch, message>`` of one line.

    Lines of another shape are kept as message only.  Lines of the right shape
    with an impossible time are not kept.
    """
    head = line_head(line)
    fields = entry_fields(_c(line), head, zone, accept_short)
    kept = (head == "") | fields["ts"].isNotNull()
    return F.struct(kept.alias("kept"), *[c.alias(name) for name, c in fields.items()])
