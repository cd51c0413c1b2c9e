"""Which nodes of a job hang, and did their stacks move?"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from trainscope.operators import logs as L
from trainscope.operators import snapshots as S
from trainscope.schemas import DEFAULT_HANG_SECONDS, DEFAULT_TAIL_LINES
from trainscope.session import stored


def rank_silence(lines: DataFrame, ranges: DataFrame | None, as_of: Column | dt.datetime | str,
                 n: int = DEFAULT_TAIL_LINES, files: DataFrame | None = None,
                 failed: DataFrame | None = None, inclusive: bool = True) -> DataFrame:
    """Silence of every rank from its last ``n`` lines; expected ranks if ranges are given."""
    parsed = L.parse_log_lines(L.tail_lines(lines, n), keep_bad_time=True)
    status = L.suspend_seconds(L.latest_log_time(L.rank_status(parsed)), as_of)
    if ranges is None:
        return status
    return L.complete_ranks(ranges, status, files, failed, inclusive)


@dataclass(frozen=True)
class HangReport:
    """The tables of one hang check."""

    status: DataFrame
    nodes: DataFrame
    errors: DataFrame
    diffs: DataFrame
    verdicts: DataFrame


def hang_check(lines: DataFrame, snaps: DataFrame, as_of: Column | dt.datetime | str,
               ranges: DataFrame | None = None, n: int = DEFAULT_TAIL_LINES,
               threshold: int = DEFAULT_HANG_SECONDS, files: DataFrame | None = None,
               inclusive: bool = True, samples: DataFrame | None = None) -> HangReport:
    """Silent ranks, their nodes, and stack differences on those nodes only.

    ``samples`` are the samples taken, as facts, so that an empty one is compared too.

    The silent nodes are stored at once: the list is short, and the logs would
    otherwise be read again for each table that follows from it.
    """
    status = rank_silence(lines, ranges, as_of, n, files, inclusive=inclusive)
    nodes = stored(L.suspicious_nodes(status, threshold), "suspects")
    suspects = S.stacks_for_suspects(snaps, nodes)
    compared = S.compare_samples(suspects, None if samples is None else samples.join(nodes.select("node").distinct(), "node", "left_semi"))
    diffs = S.stack_diffs(suspects, compared=compared)
    return HangReport(status, nodes, compared.errors, diffs, S.snapshot_verdict(suspects, diffs, compared.errors, compared.pairs))
