"""Order-dependent folds over streams, in event-time order.

Rows of a key wait in its state until the watermark has passed them; then they
are folded in the order of their time. So a row that arrives a few micro-batches
late, but within the allowed lateness, takes its place as if it had come in
time. An event-time timeout wakes the key when its next waiting row is due or
its state ends, and a key with neither rows nor state is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from cartograph.streaming.windows import event_time

LATENESS = "10 minutes"


def replay(events: DataFrame, keys: list[str], fields: list[str], out_schema: str, fold: Callable,
           lateness: str = LATENESS) -> DataFrame:
    """Streaming fold in append mode. ``events``: ``keys``, ``ts`` and
    ``fields`` (numbers, booleans or text; ties in ``ts`` are ordered by them).

    ``fold(key, state, rows, now)`` gets the key's state (anything JSON can
    hold, None at first), the rows due, as lists ``[ts, *fields]`` with ``ts``
    in microseconds, and the watermark; it returns the new state or None, the
    time at which that state ends (or None) and the output as a data frame."""
    x = event_time(events).select(*keys, "ts", *fields).withWatermark("ts", lateness)

    def step(key, pdfs, state):
        now = state.getCurrentWatermarkMs() * 1000
        kept, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        for pdf in pdfs:
            ts = pdf["ts"].values.astype("datetime64[us]").astype(np.int64).tolist()
            columns = [[None if pd.isna(v) else v for v in pdf[f].tolist()] for f in fields]
            waiting += [list(r) for r in zip(ts, *columns)]
        due = sorted((r for r in waiting if r[0] <= now), key=lambda r: (r[0], *map(str_last, r[1:])))
        waiting = [r for r in waiting if r[0] > now]
        kept, ends, out = fold(key, kept, due, now)
        if kept is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps((kept, waiting)),))
            wake = [r[0] // 1000 for r in waiting] + ([] if ends is None else [ends // 1000 + 1])
            if wake:
                state.setTimeoutTimestamp(max(min(wake), now // 1000 + 1))
        yield out

    return x.groupBy(*keys).applyInPandasWithState(step, out_schema, "saved string", "append",
                                                   GroupStateTimeout.EventTimeTimeout)


def str_last(v):
    """Sort key: nulls first, then values of one type."""
    return (v is not None, v if v is not None else 0)


def times(us: list) -> pd.Series:
    """Microseconds (or None) as timestamps."""
    return pd.Series([pd.NaT if v is None else pd.Timestamp(v, unit="us") for v in us], dtype="datetime64[ns]")
