"""Trajectories that are still open, in a stream: chains of tools and the rate of review triggers, kept as state.

``open_runs`` keeps for each trajectory what its steps so far come to, and gives a row whenever steps arrive and a last one
(closed) once none has come for ``idle_minutes``. Steps may arrive out of order, in any number of batches: state holds the runs
of consecutive steps as intervals, so what comes late joins what it belongs to. A step that comes twice counts once.

State is bounded by the gaps in a trajectory, not by its steps: consecutive steps are one interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.triggers import with_trigger

OUT = "traj string, n_steps long, cascade_depth long, n_triggers long, trigger_rate double, closed boolean"
_STATE = "seen array<struct<low:long,high:long>>, tools array<struct<low:long,high:long>>, fired long"


def merged(intervals: list[tuple[int, int]], points: list[int]) -> list[tuple[int, int]]:
    """Intervals of whole numbers with more points: those that touch are one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted([*intervals, *((p, p) for p in points)]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _holds(intervals: list[tuple[int, int]], p: int) -> bool:
    return any(low <= p <= high for low, high in intervals)


def _row(traj: str, seen: list[tuple[int, int]], tools: list[tuple[int, int]], fired: int, closed: bool) -> pd.DataFrame:
    n = sum(high - low + 1 for low, high in seen)
    depth = max((high - low + 1 for low, high in tools), default=0)
    return pd.DataFrame({"traj": [traj], "n_steps": [n], "cascade_depth": [depth], "n_triggers": [fired], "trigger_rate": [fired / n if n else 0.0], "closed": [closed]})


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    traj = key[0]
    pairs = lambda rows: [(int(r[0]), int(r[1])) for r in rows]
    seen, tools, fired = (pairs(state.get[0]), pairs(state.get[1]), int(state.get[2])) if state.exists else ([], [], 0)
    if state.hasTimedOut:
        state.remove()
        yield _row(traj, seen, tools, fired, True)
        return
    for batch in batches:
        batch = batch.drop_duplicates("step_index")
        new = batch[[not _holds(seen, int(i)) for i in batch["step_index"]]]
        fired += int(new["fired"].sum())
        seen = merged(seen, new["step_index"].astype(int).tolist())
        tools = merged(tools, new.loc[new["tool"].astype(bool), "step_index"].astype(int).tolist())
    state.update((seen, tools, fired))
    state.setTimeoutDuration(idle_ms)
    yield _row(traj, seen, tools, fired, False)


def open_runs(stream: DataFrame, idle_minutes: float = 60) -> DataFrame:
    """``stream``: traj, step_index, action, confidence. A row for each trajectory with news (update mode); rows without
    traj or step_index are left out."""
    steps = with_trigger(stream.where("traj is not null and step_index is not null"))
    tool = F.coalesce(F.col("action"), F.lit("")) != ""
    rows = steps.select("traj", F.col("step_index").cast("long").alias("step_index"), tool.alias("tool"), F.col("trigger_type").isNotNull().alias("fired"))
    ms = max(1, int(idle_minutes * 60_000))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _update(key, batches, state, ms)

    return rows.groupBy("traj").applyInPandasWithState(update, OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
