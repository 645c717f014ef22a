import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from leakgauge.llm import mixing, queries, running, shards


def jump(key, n):
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 9, 700])
def test_jump_equals_the_published_loop(spark, n):
    keys = [0, 1, -1, 7, 2**63 - 1, -2**63, *range(1000, 60_000, 997)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", shards.jump_shard(F.col("k"), n).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: jump(k, n) for k in keys}


def test_shards(awkward, awkward_rows, nothing):
    rows = shards.placed(awkward).collect()
    assert len(rows) == len(awkward_rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i or 0, 8), jump(i or 0, 9)) for i, t, *_ in awkward_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shards.placed(nothing).count() == 0


def test_shards_are_written_whole(spark, awkward, awkward_rows, tmp_path):
    shards.write_shards(awkward, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1]) for r in awkward_rows)


def test_totals_do_not_depend_on_the_buckets(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), F.col("id").alias("v"))
    def total():
        cut = running.bucketed(rows, "h", 500)
        return {r.id: r.t for r in running.with_total_before(cut, ["g"], ["h"], "v", "t").collect()}
    whole = total()
    monkeypatch.setattr(running, "ROWS_PER_BUCKET", 20)
    assert total() == whole


def water_filled(sizes, repeats=3):
    """Rounds of sharing, one after another, as the rule is told."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        shares = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] >= repeats * sizes[s] * shares}
        if not over:
            return target | {s: left * weight[s] / shares for s in open_}
        target |= {s: float(repeats * sizes[s]) for s in over}
        left -= sum(repeats * sizes[s] for s in over)
        open_ -= over
    return target


def plain_mix(rows, budget=None):
    """Words taken per (row number, turn) of (id, text, source) rows: one list, sorted and cut."""
    sizes, by_source = Counter(), defaultdict(list)
    for i, (d, text, source) in enumerate(rows):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        of_text = hashlib.md5((text or "").encode()).hexdigest()
        draw = hashlib.md5(f"{'' if d is None else d} {of_text}".encode()).hexdigest()
        by_source[source].append((draw, n, i))
    target = water_filled(sizes)
    total = min(sum(sizes.values()), budget or sum(sizes.values()))
    until = min(1.0, total / sum(target.values())) if budget else 1.0
    queue = []
    for source, goal in target.items():
        at, quota = 0, math.ceil(goal * until)
        for turn in range(3):
            for draw, n, i in sorted(by_source[source]):
                if n and at < quota:
                    finish = until if at + n >= quota else min(until, (at + n) / goal)
                    queue.append((finish, source is None, source or "", draw, i, turn, min(n, quota - at)))
                at += n
    taken = {}
    for *_, i, turn, piece in sorted(queue):
        taken[i, turn] = min(piece, total)
        total -= taken[i, turn]
    return taken


@pytest.mark.parametrize("per_range", [1000, 3])
def test_mix_equals_one_sorted_list(awkward, awkward_rows, monkeypatch, per_range):
    monkeypatch.setattr(running, "ROWS_PER_BUCKET", per_range)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", per_range)
    rows = [(r[0], r[1], r[3]) for r in awkward_rows]
    want = Counter()
    for (i, _), words in plain_mix(rows).items():
        want[rows[i][0]] += words
    got = Counter()
    for r in mixing.taken_words(awkward).collect():
        got[r.doc_id] += r.taken
    assert +got == +want
    assert sum(got.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)


def test_mix(awkward, awkward_rows, nothing):
    rows = mixing.taken_words(awkward).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, *_ in awkward_rows:
        sizes[s] += count(t)
    target = water_filled(sizes)
    by_source = defaultdict(set)
    for r in mixing.queued_documents(awkward).select("source", "target").collect():
        by_source[r.source].add(r.target)
    assert {s: v.pop() for s, v in by_source.items()} == pytest.approx(target)
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, count(t)) for i, t, *_ in awkward_rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    taken = Counter()
    for r in mixing.mixed(awkward).collect():
        taken[r.source] += r.words
    assert all(abs(taken[s] - target[s]) <= len(target) for s in target)
    assert sum(r.taken for r in rows) == sum(taken.values())
    assert mixing.taken_words(nothing).count() == 0


def test_mix_is_served_in_virtual_time_and_cut_at_the_budget(awkward):
    rows = mixing.mixed(awkward, budget=4000).collect()
    finish = [r.virtual_finish for r in rows]
    assert finish == sorted(finish)
    assert sum(r.words for r in rows) == 4000
    assert [tuple(r) for r in rows] == [tuple(r) for r in mixing.mixed(awkward, budget=4000).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir) == ""
