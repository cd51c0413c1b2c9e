"""Which alerts are new, per node?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from trainscope.operators import events as E
from trainscope.session import stored


@dataclass(frozen=True)
class AlertReport:
    alerts: DataFrame
    rollup: DataFrame
    messages: DataFrame
    marks: DataFrame


def alert_check(events: DataFrame, ledger: DataFrame, nodes: DataFrame, by: E.EventFilter,
                now_ms: int, seq: int, processing_time: str) -> AlertReport:
    """Unprocessed matches, their report and messages, and the marks to append to the ledger.

    Only alerts that a message tells are marked: those of asked nodes that answered.

    The matches are stored first, so the messages sent and the marks written are
    of the same events, whatever arrives meanwhile.
    """
    asked = E.EventFilter(by.start_ms, by.end_ms, by.min_severity, by.type, by.source, by.job_id)
    matches = E.filter_events(events, asked)
    found = E.unprocessed(matches, ledger) if by.unprocessed else E.apply_processed(matches, ledger)
    found = stored(found.select("node", "id", "timestamp", "severity", "message"), "alerts")
    told = found.join(nodes.filter("error is null").select("node").distinct(), "node", "left_semi")
    return AlertReport(found, E.alert_rollup(nodes, found),
                       E.alert_messages(nodes, found, processing_time), E.marks_for(told, now_ms, seq))
