"""Let a host through at most once per interval, measured from the last time it was let through."""

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from leakgauge.operators.behavior import window_micros


def emitted(times, last, width):
    """Positions of the sorted times that are let through."""
    found, position = [], 0
    if last is not None:
        position = int(np.searchsorted(times, last + width, side="left"))
    while position < len(times):
        found.append(position)
        position = int(np.searchsorted(times, times[position] + width, side="left"))
    return found


class Throttle(StatefulProcessor):
    """Per host: the time of the last event let through."""

    def __init__(self, width, time, ttl_ms):
        self.width, self.time, self.ttl_ms = width, time, ttl_ms

    def init(self, handle):
        self.last = handle.getValueState("last", "us bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.time, kind="stable", ignore_index=True)
        times = batch[self.time].to_numpy(np.int64)
        last = self.last.get()[0] if self.last.exists() else None
        keep = emitted(times, last, self.width)
        if keep:
            self.last.update((int(times[keep[-1]]),))
            yield batch.iloc[keep]

    def close(self):
        pass


def throttled(stream, host="requested_server_name", seconds=60.0, time="epoch_us", ttl_ms=None):
    return stream.groupBy(host).transformWithStateInPandas(
        Throttle(window_micros(seconds), time, ttl_ms),
        outputStructType=stream.schema,
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
