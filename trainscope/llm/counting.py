"""Counters of a fixed number, added up over all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trainscope.llm.words import pieces

#: Counters in one row on their way; a row is what the shuffle spreads.
STRIPE = 1 << 12


def total_counts(rows: DataFrame, count: Callable[[np.ndarray, pa.RecordBatch], None], size: int, column: str = "text") -> np.ndarray:
    """The sum of ``size`` counters that ``count(counters, piece)`` raises for each piece of the rows.

    Each task keeps one array and sends it in stripes; each stripe is added up in one place as it
    arrives.  The result has ``size`` numbers however many rows there are.
    """
    def local(batches):
        total = np.zeros(size, np.float64)
        for batch in batches:
            for piece in pieces(batch, column):
                count(total, piece)
        stripes = [total[i:i + STRIPE] for i in range(0, size, STRIPE)]
        yield pa.RecordBatch.from_pydict({"stripe": pa.array(range(len(stripes)), pa.int32()),
                                          "counts": pa.array([s.tobytes() for s in stripes], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[stripe] = total.get(stripe, 0) + np.frombuffer(counts)
        yield pa.RecordBatch.from_pydict({"stripe": pa.array(total.keys(), pa.int32()),
                                          "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    form = "stripe int, counts binary"
    got = rows.mapInArrow(local, form).repartition("stripe").mapInArrow(add, form).collect()
    total = np.zeros(size, np.float64)
    for r in got:
        total[r["stripe"] * STRIPE:(r["stripe"] + 1) * STRIPE] = np.frombuffer(r["counts"])
    return total
