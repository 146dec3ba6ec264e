"""Training events as a stream: best-so-far and early stopping with state for each run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run long, seq long, is_best boolean, no_improve int, stop boolean"
STATE = "best double, no_improve int"


def early_stopping(events: DataFrame, threshold: float = 0.5, patience: int = 5) -> DataFrame:
    """Of a stream `run, seq, loss`: for each event whether it is the best so far, and how long there was no gain.

    Events of one micro-batch are put in order by `seq`; the state of a run is two numbers.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, waited = state.get if state.exists else (None, 0)
        rows = []
        for seq, loss in pd.concat(list(frames)).sort_values("seq")[["seq", "loss"]].itertuples(index=False):
            gain = best is None or loss < best - threshold
            is_best = best is None or loss < best
            waited = 0 if gain else waited + 1
            best = loss if is_best else best
            rows.append((key[0], seq, is_best, waited, waited >= patience))
        state.update((float(best), waited))
        yield pd.DataFrame(rows, columns=["run", "seq", "is_best", "no_improve", "stop"])

    return events.groupBy("run").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
