"""Run states over a stream of harness events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.evidence import MAX_REPAIRS, MAX_TOOL_CALLS

STATE = "events long, phase string, tools long, repairs long"
OUTPUT = "run string, events long, phase string, tools long, repairs long"
#: Events that set a phase whatever the counters.
SETS = {"STRATEGY_CHOSEN": "STRATEGY_SELECTED", "EVIDENCE_ADDED": "EVIDENCE_ACCUMULATED", "ANSWER_PROPOSED": "VERIFYING", "EXECUTION_COMPLETED": "COMPLETED", "EXECUTION_FAILED": "FAILED"}


def fold(state: tuple[int, str, int, int], kinds: list[str], max_tools: int = MAX_TOOL_CALLS, max_repairs: int = MAX_REPAIRS) -> tuple[int, str, int, int]:
    """The state after further events."""
    events, phase, tools, repairs = state
    for kind in kinds:
        events += 1
        tools += kind == "TOOL_CALLED"
        repairs += kind == "REPAIR_ATTEMPTED"
        if kind == "TOOL_CALLED" and tools > max_tools:
            phase = "FAILED"
        elif kind == "REPAIR_ATTEMPTED":
            phase = "FAILED" if repairs > max_repairs else "REPAIRING"
        else:
            phase = SETS.get(kind, phase)
    return events, phase, tools, repairs


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else (0, "INITIALIZED", 0, 0)
    rows = pd.concat(list(batches)).sort_values("seq")  # a run's events of one micro-batch
    now = fold(now, rows["kind"].tolist())
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=["run", "events", "phase", "tools", "repairs"])


def run_states_stream(events: DataFrame) -> DataFrame:
    """Streaming states of runs from events ``run string, seq, kind``, in update mode; events of a run must arrive in order of their micro-batches."""
    return events.groupBy("run").applyInPandasWithState(_update, OUTPUT, STATE, "update", "NoTimeout")


def event_counts_stream(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by time window and kind with a watermark on ``ts``."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
