"""Captures remembered by recency, against a plain list of the most recent ones."""

import random

import pytest

from leakgauge.sources.json import explode_batches, sensor_stream
from leakgauge.contract import SENSOR_SCHEMA
from leakgauge.streaming import recency
from leakgauge.streaming.history import parse_stream, replayed_window_features, stream_window_features
from test_streaming import finish, put, query, run


def plain_since(captures, most):
    """The arrival number each use's history began with."""
    recent, out = {}, []
    for number, capture in enumerate(captures):
        since = recent.pop(capture, number)
        recent[capture] = since
        if len(recent) > most:
            del recent[next(iter(recent))]
        out.append(since)
    return out


@pytest.mark.parametrize("chunk,limit", [(1024, 1000), (7, 1000), (7, 20)])
def test_histories_equal_a_plain_list(spark, monkeypatch, chunk, limit):
    monkeypatch.setattr(recency, "CHUNK_BATCHES", chunk)
    rng = random.Random(3)
    captures = [rng.choice("aaaabcdefgh") for _ in range(120)]
    rows = spark.createDataFrame([(n, c, k) for n, c in enumerate(captures) for k in range(2)] + [(500, None, 0)], "batch_seq long, capture_id string, seq long")
    got = recency.with_capture_history(rows, 3, limit=limit).collect()
    want = plain_since(captures, 3)
    assert {(r.batch_seq, r.history_since) for r in got} == {*enumerate(want), (500, None)}
    assert len(got) == 241


def test_the_least_recently_used_capture_goes(spark):
    captures = ["cap_1", "cap_2", "cap_3", "cap_1", "cap_4", "cap_2", "cap_1"]
    rows = spark.createDataFrame([(n, c, 0) for n, c in enumerate(captures)], "batch_seq long, capture_id string, seq long")
    got = {r.batch_seq: r.history_since for r in recency.with_capture_history(rows, 3).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 5, 6: 0}
    assert recency.with_capture_history(rows.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source, rows_path, held_path = tmp_path / "in", str(tmp_path / "rows"), str(tmp_path / "held")
    source.mkdir()
    captures = ["a", "b", "a", "c", "b", "a"]
    for number, capture in enumerate(captures):
        put(source, number, capture, [query(number * 5, f"{number}.evil.info"), query(number * 5 + 1, "x.evil.info")])
    parsed = parse_stream(sensor_stream(spark, str(source), 2)).where("problem IS NULL").drop("problem")
    write = recency.recency_writer(rows_path, held_path, 2)
    finish(parsed.writeStream.foreachBatch(lambda rows, k: [write(rows, k), write(rows, k)] and None).option("checkpointLocation", str(tmp_path / "cp")))
    schema = spark.read.parquet(rows_path).drop("batch_id").schema
    second = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(rows_path + "/batch_id=*")
    got = run(spark, stream_window_features(second), tmp_path, "recency")
    stored = parse_stream(explode_batches(spark.read.schema(SENSOR_SCHEMA).json(str(source)))).drop("problem")
    batch = replayed_window_features(recency.with_capture_history(stored, 2))
    facts = lambda df: sorted((r.batch_seq, r.seq, r.history_since, r.status, r.query_frequency, r.unique_subdomains) for r in df.collect())
    assert facts(got) == facts(batch)
    assert [f[2] for f in facts(batch)[::2]] == plain_since(captures, 2) == [0, 1, 0, 3, 4, 5]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
