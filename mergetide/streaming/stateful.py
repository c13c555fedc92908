"""Kernels as custom streaming state: one compact state for each key, updated batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_stream(stream: DataFrame, by: str, value: str, new: Callable[[], object], load: Callable[[str], object], idle_ms: int | None = None) -> DataFrame:
    """by, state: in update mode, the state of each key that got rows.  Idle keys are dropped after ``idle_ms``."""
    kind = dict(stream.dtypes)[by]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kernel = load(state.get[0]) if state.exists else new()
        for batch in batches:
            kernel.add(batch[value].dropna().to_numpy())
        text = kernel.dump()
        state.update((text,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({by: [key[0]], "state": [text]})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.select(by, value).groupBy(by).applyInPandasWithState(update, f"`{by}` {kind}, state string", "state string", "update", timeout)
