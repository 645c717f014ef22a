"""Window features over a stream: history per capture, client and domain outlives the micro-batch.

Within a group records are taken in (arrival batch, time, position) order. A record earlier than the last
accepted one of its own group is late. This is a rule per group, not a watermark over the whole stream.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from leakgauge.contract import FIRST_INTERVAL, GROUP_KEYS, WINDOW_SECONDS
from leakgauge.operators.behavior import window_micros, with_window_features
from leakgauge.operators.validate import with_problem
from leakgauge.plans.ordered import ROWS_PER_TASK, highest_before, with_running

ARRIVAL = ("batch_seq", "epoch_us", "seq")
KEYS = ("capture_id", *GROUP_KEYS)


def history_keys(rows):
    """Keys of a history; where captures are remembered by recency, also the batch it began with."""
    return (*KEYS, *(c for c in ("history_since",) if c in rows.columns))


LATE, NO_CAPTURE = "older_than_history", "missing_capture"
ADDED = [
    T.StructField("query_frequency", T.IntegerType()),
    T.StructField("unique_subdomains", T.IntegerType()),
    T.StructField("time_interval", T.DoubleType()),
    T.StructField("status", T.StringType()),
]


def window_counts(times, subdomains, width):
    """Queries and distinct sub-domains in [t - width, t] for each entry of one group, in order."""
    begin = np.searchsorted(times, times - width, side="left")
    frequency = np.arange(1, len(times) + 1) - begin
    by_name = pd.Series(times).groupby(pd.Series(subdomains), sort=False)
    before, after = by_name.shift(1).to_numpy(float), by_name.shift(-1).to_numpy(float)
    starts = ~(before >= times - width)
    ended = times[~(after <= times + width)]
    distinct = np.cumsum(starts) - np.searchsorted(ended, times - width, side="left")
    return frequency, distinct


#: Time buckets a window is divided into; parts of a bucket before they are folded into one; rows of a group at a time.
BUCKETS, FOLD, SLICE = 16, 16, 100_000


class History(StatefulProcessor):
    """Per group: the entries of the last window in time buckets, and the time of the last accepted record.

    A batch appends one part to each bucket it has rows for and removes the buckets that left the window, so what is
    written grows with the new rows and not with the window. A bucket of ``FOLD`` parts is folded into one. A large group
    goes through in slices of ``SLICE`` rows.
    """

    def __init__(self, width, late, ttl_ms):
        self.width, self.late, self.ttl_ms = width, late, ttl_ms
        self.bucket = -(-width // BUCKETS)

    def init(self, handle):
        self.entries = handle.getMapState("entries", "bucket bigint, part bigint", "us array<bigint>, subdomain array<string>", self.ttl_ms)
        self.last = handle.getValueState("last", "us bigint, parts bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)  # one group of one micro-batch
        batch = batch.sort_values(list(ARRIVAL), kind="stable", ignore_index=True)
        for start in range(0, len(batch), SLICE):
            yield self._slice(key, batch.iloc[start:start + SLICE].reset_index(drop=True))

    def _held(self):
        """The parts of the window by (bucket, part), in order."""
        return sorted((tuple(k), v) for k, v in self.entries.iterator())

    def _store(self, held, times, names, parts):
        """Append the new entries to their buckets, fold buckets of many parts, remove those that left the window."""
        by_bucket = {}
        for (bucket, part), value in held:
            if (bucket + 1) * self.bucket <= times[-1] - self.width:
                self.entries.removeKey((bucket, part))
            else:
                by_bucket.setdefault(bucket, []).append((part, value))
        buckets = times // self.bucket
        starts = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1))
        for begin, end in zip(starts, [*starts[1:], len(times)]):
            bucket, us, subdomains = int(buckets[begin]), times[begin:end].tolist(), names[begin:end]
            if (bucket + 1) * self.bucket <= times[-1] - self.width:
                continue
            old = by_bucket.get(bucket, [])
            if len(old) >= FOLD:
                for part, _ in old:
                    self.entries.removeKey((bucket, part))
                us = [t for _, v in old for t in v[0]] + us
                subdomains = [n for _, v in old for n in v[1]] + subdomains
            self.entries.updateValue((bucket, parts), (us, subdomains))
        self.last.update((int(times[-1]), parts + 1))

    def _slice(self, key, batch):
        last, parts = self.last.get() if self.last.exists() else (None, 0)
        times = batch["epoch_us"].to_numpy(np.int64)
        floor = np.iinfo(np.int64).min if last is None else last
        accepted = times >= np.maximum.accumulate(np.maximum(times, floor))
        if self.late == "fail" and not accepted.all():
            raise ValueError(f"a record of {key} is older than its history")
        out = batch.assign(query_frequency=0, unique_subdomains=0, time_interval=np.nan, status="rejected")
        good = batch[accepted]
        if len(good):
            held = self._held()
            fresh, names = good["epoch_us"].to_numpy(np.int64), good["subdomain"].tolist()
            old_times = np.array([t for _, v in held for t in v[0]], dtype=np.int64)
            frequency, distinct = window_counts(np.concatenate([old_times, fresh]), [n for _, v in held for n in v[1]] + names, self.width)
            new = len(old_times)
            seconds = fresh / 1e6
            first = FIRST_INTERVAL if last is None else seconds[0] - last / 1e6
            out.loc[accepted, "query_frequency"] = frequency[new:]
            out.loc[accepted, "unique_subdomains"] = distinct[new:]
            out.loc[accepted, "time_interval"] = np.concatenate([[first], np.diff(seconds)])
            out.loc[accepted, "status"] = "accepted"
            self._store(held, fresh, names, parts)
        for name in ("query_frequency", "unique_subdomains"):
            out[name] = out[name].where(out["status"] == "accepted").astype("Int32")
        out["time_interval"] = out["time_interval"].astype("Float64")
        return out

    def close(self):
        pass


def stream_window_features(rows, window_seconds=WINDOW_SECONDS, late="reject", ttl_ms=None):
    """Add window features and a status to parsed stream rows.

    ``late`` is 'reject' (keep the record, without features) or 'fail' (stop the query). With ``ttl_ms``
    groups that were idle for that long are forgotten.
    """
    if late not in ("reject", "fail"):
        raise ValueError("late must be 'reject' or 'fail'")
    schema = T.StructType([*rows.schema.fields, *ADDED])
    return rows.groupBy(*history_keys(rows)).transformWithStateInPandas(
        History(window_micros(window_seconds), late, ttl_ms),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


def replayed_window_features(rows, window_seconds=WINDOW_SECONDS, limit=ROWS_PER_TASK):
    """The same result for a stored stream, as one batch job.

    A record is late exactly if an earlier arrival of its group has a later time, because rejected records
    never raise that maximum.
    """
    keys = history_keys(rows)
    ordered = with_running(rows, keys, ARRIVAL, limit=limit, __highest=highest_before(F.col("epoch_us")))
    late = F.coalesce(F.col("epoch_us") < F.col("__highest"), F.lit(False))
    marked = ordered.withColumn("__late", late).drop("__highest")
    swept = with_window_features(marked, keys, window_seconds, ("batch_seq", "seq"), limit=limit, ignored="__late")
    return swept.withColumn("status", F.when(F.col("__late"), "rejected").otherwise("accepted")).drop("__late")


def parse_stream(raw):
    """Parsed rows of a sensor stream; those without a readable time or without a capture keep a problem code.

    A batch that names no capture cannot be told from another sensor's: it has no history of its own and must not share
    one, so its rows are counted as problems like unreadable ones.
    """
    from leakgauge.functions.domain import with_domain_parts

    flagged = with_problem(raw.withColumn("label", F.lit(0)))
    named = flagged.withColumns({
        "requested_server_name": F.col("normal_name"),
        "problem": F.when(F.col("epoch_us").isNull(), "bad_timestamp").when(
            F.trim(F.coalesce("capture_id", F.lit(""))) == "", NO_CAPTURE),
    }).drop("normal_name", "label")
    return with_domain_parts(named)
