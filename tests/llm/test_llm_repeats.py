"""Removal of repeated strings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakgauge.llm import repeats

L = repeats.LENGTH


def plain_report(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k:k + L] for _, d in texts for k in range(len(d) - L + 1))
    for i, d in texts:
        gone = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - L + 1):
            if count[d[k:k + L]] > 1:
                gone[k + 1:k + 1 + L] = True
        left = bytes(b for b, g in zip(d, gone[1:]) if not g)
        yield i, len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()


def report(docs):
    return Counter(tuple(r) for r in repeats.removal_report(docs).collect())


def test_awkward_rows(awkward, awkward_rows, nothing):
    rows = [(i, t if len(t or "") < 9000 else t[:9000]) for i, t, *_ in awkward_rows]
    short = awkward.selectExpr("doc_id", "substring(text, 1, 9000) as text", "bucket", "mark")
    assert report(short) == Counter(plain_report(rows))
    assert repeats.removal_report(nothing).count() == 0


def planted(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [line(n) for n in (200, 330, 398, 399, 400, 401, 520, 900)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            cut = rng.randint(0, 30)
            parts += [line(rng.randint(0, 300)), s[cut:] if rng.random() < 0.3 else s]
        rows.append((i, "".join(parts) + line(rng.randint(0, 200))))
    rows.append((70, rows[3][1]))
    rows.append((71, line(450) * 2))
    rows.append((72, "abc" * 300))
    rows.append((73, line(100) + "abc" * 200 + line(100)))
    rows.append((74, "x" * 401))
    rows.append((75, "y" * 400))
    return rows


@pytest.mark.parametrize("many,together,place", [(2000, 2 << 20, 20), (1, 5000, 20), (3, 2 << 20, 11)])
def test_planted_repeats(spark, monkeypatch, many, together, place):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "TOGETHER", together)
    if place != 20:  # texts are hashed in small overlapping pieces
        monkeypatch.setattr(repeats, "BUFFER", 1 << (place - 1))
    rows = planted(many)
    docs = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, place string").repartition(4)
    assert report(docs) == Counter(plain_report(rows))


@pytest.mark.parametrize("shares", [1, 20])
def test_planted_repeats_of_rare_and_frequent_contents(spark, monkeypatch, shares):
    monkeypatch.setattr(repeats, "SHARES", shares)
    rows = planted(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert report(docs) == Counter(plain_report(rows))


def test_places_of_one_content_stay_in_many_tasks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables of full size
    try:
        rows = [(1, 1, k) for k in range(4000)] + [(1, 2 + k // 3, k) for k in range(4000, 7000)] + [(2, k, k) for k in range(7000, 7500)]
        places = spark.createDataFrame(rows, "anchor long, content long, place long").repartition(8)
        found = repeats.copied_places(places, places.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n")))
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    size = Counter((a, c) for a, c, _ in rows)
    assert sorted(tuple(r)[:3] for r in got) == sorted(r for r in rows if size[r[:2]] > 1)
    assert max(Counter(r["task"] for r in got if r["content"] == 1).values()) <= 1000


def test_bucket_refinement_stops_at_the_length():
    rng = random.Random(1)
    a, b = (bytes(rng.randrange(3) for _ in range(700)) for _ in range(2))
    data = a + b[:50] + a[100:520] + b[50:] + a[100:499]
    counts = Counter(data[k:k + L] for k in range(len(data) - L + 1))
    starts = np.arange(len(data) - L + 1)
    want = [k for k in starts if counts[data[k:k + L]] > 1]
    assert repeats.repeated_starts(data, starts).tolist() == want


def test_spans_unite():
    assert repeats.united([(5, 9), (0, 2), (2, 4), (8, 12)]) == [[0, 4], [5, 12]]
    assert repeats.kept_bytes(b"0123456789", [[0, 4], [5, 9]]) == b"49"
