"""Streaks carried from run to run as stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOW, WARNING = 3, 1


def accept_streaks(runs: DataFrame) -> DataFrame:
    """(source, run, streak, state) for a stream of (source, run, accepted): runs in a row without an accepted item.

    Rows of one micro-batch are taken in the order of ``run``; a run at or before the last one seen is a replay and is passed over.
    State is two numbers a source.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak = state.get if state.exists else (-1, 0)
        out = []
        for run, accepted in pd.concat(list(batches)).sort_values("run")[["run", "accepted"]].itertuples(index=False):
            if run <= last:
                continue
            last, streak = int(run), 0 if accepted > 0 else streak + 1
            out.append((key[0], last, streak, "low" if streak >= LOW else "warning" if streak >= WARNING else "configured"))
        state.update((last, streak))
        yield pd.DataFrame(out, columns=["source", "run", "streak", "state"])

    return runs.groupBy("source").applyInPandasWithState(step, "source string, run long, streak long, state string", "last long, streak long", "append", GroupStateTimeout.NoTimeout)
