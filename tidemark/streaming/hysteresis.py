"""Hysteresis events of unbounded signals: state is two numbers and a peak for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "open boolean, up timestamp, peak double"


def schmitt_stream(stream: DataFrame, key: str, time: str, value: str, on: float, off: float) -> DataFrame:
    """key, up, down, peak of each event once it closes. Rows of a batch are put in order of time."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(time)
        is_open, up, peak = state.get if state.exists else (False, None, None)
        out = []
        for t, v in zip(rows[time], rows[value], strict=True):
            if not is_open and v >= on:
                is_open, up, peak = True, t, v
            elif is_open and v <= off:
                out.append((k[0], up, t, peak))
                is_open = False
            elif is_open and v > peak:
                peak = v
        state.update((is_open, up if up is not None else pd.Timestamp(0), float(peak if peak is not None else 0)))
        if out:
            yield pd.DataFrame(out, columns=[key, "up", "down", "peak"])

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, up timestamp, down timestamp, peak double", STATE, "append", GroupStateTimeout.NoTimeout)
