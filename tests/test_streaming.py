import json
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leakgauge.plans.forest import Bundle
from leakgauge.sources.json import explode_batches, sensor_stream
from leakgauge.streaming import history, live
from leakgauge.streaming.history import parse_stream, replayed_window_features, stream_window_features
from leakgauge.streaming.throttle import emitted, throttled


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def query(second, name="a.evil.info", src="10.0.0.1", day="2026-10-20"):
    return {
        "timestamp": f"{day} 09:{second // 60:02d}:{second % 60:02d}.000", "src_ip": src, "dst_ip": "10.0.0.2",
        "requested_server_name": name, "query_type": "TXT",
    }


def put(folder, number, capture, queries):
    path = folder / f"{number:05d}.json"
    path.write_text(json.dumps({"batch_seq": number, "capture_id": capture, "queries": queries}))
    os.utime(path, (1_700_000_000 + number,) * 2)  # the file source reads older files first


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()


def run(spark, df, tmp_path, name):
    finish(df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp" / name)).outputMode("append"))
    return spark.table(name)


def key(df):
    return sorted(
        (r.batch_seq, r.seq, r.status, r.query_frequency, r.unique_subdomains, None if r.time_interval is None else round(r.time_interval, 9))
        for r in df.collect()
    )


def test_history_outlives_batches_and_late_records_are_rejected(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, 1, "a", [query(1, "x.evil.info")])
    put(source, 2, "a", [query(3, "y.evil.info")])
    put(source, 3, "b", [query(30)])
    put(source, 4, "b", [query(10), query(40), query(30)])
    put(source, 5, "a", [query(3, "x.evil.info"), query(100, "z.evil.info")])
    stream = parse_stream(sensor_stream(spark, str(source), 1))
    got = run(spark, stream_window_features(stream.drop("problem")), tmp_path, "history")
    assert key(got) == [
        (1, 0, "accepted", 1, 1, -1.0), (2, 0, "accepted", 2, 2, 2.0), (3, 0, "accepted", 1, 1, -1.0),
        (4, 0, "rejected", None, None, None), (4, 1, "accepted", 3, 1, 10.0), (4, 2, "accepted", 2, 1, 0.0),
        (5, 0, "accepted", 3, 2, 0.0), (5, 1, "accepted", 1, 1, 97.0),
    ]


def test_stream_equals_batch_whatever_the_micro_batches(spark, tmp_path):
    rng = random.Random(4)
    source = tmp_path / "in"
    source.mkdir()
    for number in range(6):
        start = number * 25
        put(source, number, rng.choice("ab"), [
            query(start + rng.randrange(-15, 40) if start else rng.randrange(40), f"{rng.choice('uvw')}.evil.info", rng.choice(["10.0.0.1", "10.0.0.2"]))
            for _ in range(15)
        ])
    one_by_one = run(spark, stream_window_features(parse_stream(sensor_stream(spark, str(source), 1)).drop("problem")), tmp_path, "single")
    at_once = run(spark, stream_window_features(parse_stream(sensor_stream(spark, str(source))).drop("problem")), tmp_path, "joint")
    stored = explode_batches(spark.read.schema("batch_seq bigint, capture_id string, queries array<struct<timestamp string, src_ip string, dst_ip string, requested_server_name string, query_type string, source string, capture_id string>>").json(str(source)))
    batch = replayed_window_features(parse_stream(stored).drop("problem"))
    hot = replayed_window_features(parse_stream(stored).drop("problem"), limit=10)
    assert key(one_by_one) == key(at_once) == key(batch) == key(hot)
    assert {r.status for r in batch.collect()} == {"accepted", "rejected"}


def test_late_record_can_fail_the_query(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, 1, "a", [query(30)])
    put(source, 2, "a", [query(10)])
    stream = stream_window_features(parse_stream(sensor_stream(spark, str(source), 1)).drop("problem"), late="fail")
    with pytest.raises(Exception, match="older than its history"):
        run(spark, stream, tmp_path, "strict")


def test_state_can_expire(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, 1, "a", [query(30)])
    stream = stream_window_features(parse_stream(sensor_stream(spark, str(source), 1)).drop("problem"), ttl_ms=3_600_000)
    # A query with processing-time state never runs dry, so it is stopped once the row is there.
    active = stream.writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        deadline = time.time() + 60
        while spark.table("ttl").count() == 0 and time.time() < deadline:
            time.sleep(0.5)
        assert spark.table("ttl").count() == 1
    finally:
        active.stop()


def test_throttle():
    import numpy as np

    times = np.array([0, 10, 59, 60, 61, 130, 131])
    assert emitted(times, None, 60) == [0, 3, 5]
    assert emitted(times, 5, 60) == [5]


def test_throttled_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, 1, "a", [query(0), query(30), query(60)])
    put(source, 2, "a", [query(90), query(121), query(90, "other.org")])
    stream = throttled(parse_stream(sensor_stream(spark, str(source), 1)).select("requested_server_name", "epoch_us", "seq"))
    got = run(spark, stream, tmp_path, "throttle")
    assert sorted((r.requested_server_name, r.seq) for r in got.collect()) == [
        ("a.evil.info", 0), ("a.evil.info", 1), ("a.evil.info", 2), ("other.org", 2)
    ]


def test_live_ingest_writes_alerts_and_counts_once(spark, tmp_path, tiny_model):
    source = tmp_path / "in"
    source.mkdir()
    put(source, 1, "a", [query(i, f"{'q' * 40}{i}.evil.info") for i in range(1, 6)] + [{**query(9), "timestamp": "nonsense"}])
    put(source, 2, "a", [query(2, "www.good.org"), query(1, "w.evil.info")])
    bundle = Bundle(tiny_model, 0.5)
    arriving = live.live_rows(sensor_stream(spark, str(source), 1), bundle)
    _, unreadable = live.scored_stream(sensor_stream(spark, str(source), 1), bundle)
    alerts, counts, errors = (str(tmp_path / n) for n in ("alerts", "counts", "errors"))
    for attempt in range(2):  # the second run repeats both batches from a new checkpoint
        finish(arriving.writeStream.foreachBatch(live.ingest_writer(bundle, alerts, counts, errors)).option("checkpointLocation", str(tmp_path / f"c{attempt}")))
    totals = live.live_totals(spark.read.parquet(counts)).collect()
    assert [tuple(r) for r in totals] == [("a", 6, 5, 1)]
    assert tuple(spark.read.parquet(counts).agg(F.sum("rejected"), F.sum("unreadable")).first()) == (2, 1)
    found = spark.read.parquet(errors).orderBy("batch_id").collect()
    assert [(r.batch_seq, r.seq, r.error) for r in found] == [(1, 5, "bad_timestamp"), (2, 1, "older_than_history")]
    assert spark.read.parquet(alerts).select("alert_id").distinct().count() == spark.read.parquet(alerts).count() == 5
    bad = run(spark, unreadable.select("capture_id", "seq", "problem"), tmp_path, "unreadable")
    assert [tuple(r) for r in bad.collect()] == [("a", 5, "bad_timestamp")]
    live.reset_tables(spark, [alerts, counts])
    assert spark.read.parquet(alerts).count() == spark.read.parquet(counts).count() == 0


def test_totals_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "counts")
    spark.createDataFrame([("a", 3, 1), ("a", 2, 2), ("b", 1, 0)], "capture_id string, accepted bigint, suspicious bigint").write.parquet(path)
    stream = live.live_totals(spark.readStream.schema("capture_id string, accepted bigint, suspicious bigint").parquet(path))
    finish(stream.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")))
    assert sorted(map(tuple, spark.table("totals").collect())) == [("a", 5, 3, 2), ("b", 1, 0, 1)]


def test_digest_reports_only_new_alerts(spark, tmp_path):
    published = []
    write = live.digest_writer(str(tmp_path / "seen"), lambda df, n: published.append((n, df.collect()[0])), primed=False)

    def alerts(ids):
        return spark.createDataFrame(
            [(f"alt_{i}", i, f"x{i}.d{i % 5}.net", f"10.0.0.{i % 2}") for i in ids],
            "alert_id string, alert_seq bigint, requested_server_name string, src_ip string",
        )

    write(alerts(range(3)), 0)
    assert published == []
    write(alerts(range(3)), 1)
    assert published == []
    write(alerts(range(10)), 2)
    assert [(n, r.alerts, r.domains, r.hosts) for n, r in published] == [
        (2, 7, ["d3.net", "d4.net", "d0.net"], ["10.0.0.1", "10.0.0.0"])
    ]
    again = live.digest_writer(str(tmp_path / "seen"), lambda df, n: published.append((n, df.collect()[0])), primed=False, keep_batches=1)
    again(alerts(range(8, 12)), 3)  # after a restart; batch 2 is still remembered
    again(alerts([0]), 4)  # batch 0 is not
    assert [(n, r.alerts) for n, r in published[1:]] == [(3, 2), (4, 1)]


def test_rejection_sample(spark):
    late = spark.createDataFrame([("a", 4, "rejected"), ("a", 5, "accepted")], "capture_id string, seq bigint, status string")
    bad = spark.createDataFrame([("a", 9, "bad_timestamp")], "capture_id string, seq bigint, problem string")
    assert [(r.seq, r.error) for r in live.rejection_sample(late, bad).collect()] == [(9, "bad_timestamp"), (4, "older_than_history")]


class Held:
    """State of one group in memory; counts what is written."""

    def __init__(self):
        self.value, self.map, self.written = None, {}, 0

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def iterator(self):
        return iter(list(self.map.items()))

    def removeKey(self, key):
        del self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value
        self.written += len(value[0])

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def group_batches(rng, batches, rows, span):
    at = 0
    for number in range(batches):
        out = []
        for seq in range(rows):
            at += rng.randrange(span)
            out.append((number, at, seq, f"n{rng.randrange(40)}"))
        yield pd.DataFrame(out, columns=["batch_seq", "epoch_us", "seq", "subdomain"])


@pytest.mark.parametrize("slice_rows, span", [(100_000, 40), (7, 40), (100_000, 4000)])
def test_state_in_buckets_equals_one_list(monkeypatch, slice_rows, span):
    monkeypatch.setattr(history, "SLICE", slice_rows)
    frames = list(group_batches(random.Random(span), 60, 20, span))
    group, state = history.History(9_000, "reject", None), Held()
    group.init(state)
    got = pd.concat([out for f in frames for out in group.handleInputRows(("a",), iter([f]), None)], ignore_index=True)
    whole = pd.concat(frames, ignore_index=True)
    frequency, distinct = history.window_counts(whole["epoch_us"].to_numpy(), whole["subdomain"].tolist(), 9_000)
    assert got["query_frequency"].tolist() == frequency.tolist() and got["unique_subdomains"].tolist() == distinct.tolist()
    newest = whole["epoch_us"].iloc[-1]
    assert all((b + 1) * group.bucket > newest - 9_000 for b, _ in state.map)
    assert state.written <= 3 * len(whole) * (5 if slice_rows < 100 else 1)


def test_a_window_of_many_rows_is_not_written_again():
    frames = list(group_batches(random.Random(1), 40, 500, 10))
    group, state = history.History(10**9, "reject", None), Held()
    group.init(state)
    before = []
    for f in frames:
        start = state.written
        list(group.handleInputRows(("a",), iter([f]), None))
        before.append(state.written - start)
    assert sorted(before)[len(before) // 2] == 500 and sum(before) < 4 * 40 * 500


def test_a_million_rows_of_one_group_in_one_batch():
    n = 1_000_000
    frame = pd.DataFrame({"batch_seq": 0, "epoch_us": np.arange(n) // 3, "seq": np.arange(n), "subdomain": [f"n{i % 1000}" for i in range(n)]})
    group, state = history.History(300_000, "fail", None), Held()
    group.init(state)
    rows = 0
    for out in group.handleInputRows(("a",), (frame.iloc[i:i + 10_000] for i in range(0, n, 10_000)), None):
        rows += len(out)
        assert out["status"].eq("accepted").all()
    assert rows == n and out["query_frequency"].iloc[-1] == int((frame["epoch_us"] >= frame["epoch_us"].iloc[-1] - 300_000).sum())
    assert out["unique_subdomains"].iloc[-1] == 1000


def test_rows_without_a_capture_share_no_history(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, 1, None, [query(1)])
    put(source, 2, " ", [query(2)])
    put(source, 3, "a", [query(3)])
    parsed = parse_stream(sensor_stream(spark, str(source)))
    got = run(spark, parsed.select("batch_seq", "problem"), tmp_path, "captures")
    assert sorted(map(tuple, got.collect())) == [(1, "missing_capture"), (2, "missing_capture"), (3, None)]
