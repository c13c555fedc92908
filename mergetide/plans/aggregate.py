"""Two-phase aggregation with a kernel: states of partitions, then a merge tree.

For summaries that depend on the order or on random choices.  Each task folds its rows into one small state for
each group; states are merged ``FAN_IN`` at a time over ``LEVELS`` levels, so no task reads more of them for a group
as long as there are at most ``FAN_IN ** LEVELS``, about a million, partitions.  Kernels have ``add(values)``, ``merge(other)``, ``dump()``
and a static ``load(text)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN, LEVELS = 32, 4
#: Tasks that rows are dealt to by their order.
DEALT = 64
#: Groups that a task holds at once before it gives their states out and starts anew.
HELD = 2000


def _schema(df: DataFrame, by: Sequence[str], more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by), more])


def summarise(df: DataFrame, by: Sequence[str], values: Sequence[str], new: Callable[[int], object], load: Callable[[str], object], order: Sequence[str] = ()) -> DataFrame:
    """by..., state.  ``new(partition)`` makes an empty kernel; rows with a null in ``values`` are skipped.

    With ``order`` the rows are dealt to ``DEALT`` tasks by a hash of group and order and sorted there, so that reruns
    agree and no group is one task's.  Without it, rows are taken as they are partitioned.
    """
    by, values = list(by), list(values)
    for v in values:
        df = df.where(F.col(v).isNotNull())
    if order:
        df = df.repartition(DEALT, *by, *order).sortWithinPartitions(*by, *order)
    rows = df.select(*by, *values)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        held: dict[tuple, object] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*k, pid, s.dump()) for k, s in held.items()], columns=[*by, "_pid", "state"])

        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False) if by else [((), batch)]:
                if key not in held:
                    if len(held) >= HELD:
                        yield out()
                        held = {}
                    held[key] = new(pid)
                held[key].add(*(part[v].to_numpy() for v in values))
        if held:
            yield out()

    states = rows.mapInPandas(fold, _schema(rows, by, "_pid int, state string"))
    return merge_states(states, by, load)


def merge_states(states: DataFrame, by: Sequence[str], load: Callable[[str], object]) -> DataFrame:
    """``states``: by..., _pid, state -> by..., state, merged in order of ``_pid``."""
    by = list(by)
    schema = _schema(states, by, "_pid int, state string")

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pid", kind="stable")
        whole = load(part["state"].iloc[0])
        for s in part["state"].iloc[1:]:
            whole.merge(load(s))
        return part.iloc[:1].assign(state=whole.dump())[[*by, "_pid", "state"]]

    for level in range(1, LEVELS):
        states = states.groupBy(*by, F.floor(F.col("_pid") / FAN_IN**level).alias("_level")).applyInPandas(join, schema)
    return states.groupBy(*by).applyInPandas(join, schema).drop("_pid")
