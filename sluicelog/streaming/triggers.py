"""Triggers of core domains on a stream, by custom state: one number a client."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship
from .windows import with_time


def stream_triggers(flows: DataFrame, cores: list[str], gap: float, late: str = "10 minutes") -> DataFrame:
    """``c_ip, core, start``: flows to a core domain more than ``gap`` seconds after the client's flow before.

    As the batch operator, in the order in which micro-batches bring the flows
    (within one, by time); a client's first flow is none. The state, the time
    of the client's last flow, is dropped once the watermark has passed it by
    an hour and the gap, after which the next flow counts as a first one.
    """
    ship(flows.sparkSession)
    known, keep_ms = frozenset(cores), int((gap + 3600) * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(parts).sort_values("time_start", kind="stable")
        out = []
        for t, name in zip(rows["time_start"].tolist(), rows["name"].tolist(), strict=True):
            if last is not None and name in known and t - last > gap:
                out.append((key[0], name, t))
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000) + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["c_ip", "core", "start"])

    timed = with_time(flows, "time_start", late).select("c_ip", "name", "time_start", "event_time")
    return timed.groupBy("c_ip").applyInPandasWithState(step, "c_ip string, core string, start double", "last double", "append", GroupStateTimeout.EventTimeTimeout)
