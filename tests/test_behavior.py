import random

import pytest
from pyspark.sql import functions as F

from leakgauge.contract import DataError
from leakgauge.operators.behavior import require_chronological, retime, with_window_features
from leakgauge.plans.ordered import (
    Layout, following, highest_before, last_known, previous, running_sum, with_running,
)

COLUMNS = "row_id bigint, src_ip string, apex_domain string, subdomain string, epoch_us bigint"


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def brute_force(rows, width_us):
    """One query after the other, looking back over the whole history."""
    expected = {}
    for row_id, src, apex, sub, at in sorted(rows, key=lambda r: (r[4], r[0])):
        earlier = [r for r in rows if r[1:3] == (src, apex) and (r[4], r[0]) <= (at, row_id)]
        inside = [r for r in earlier if r[4] >= at - width_us]
        times = sorted(r[4] for r in earlier if r[0] != row_id)
        gap = at / 1e6 - times[-1] / 1e6 if times else -1.0
        expected[row_id] = (len(inside), len({r[3] for r in inside}), gap)
    return expected


def measured(df):
    return {
        r.row_id: (r.query_frequency, r.unique_subdomains, r.time_interval)
        for r in df.select("row_id", "query_frequency", "unique_subdomains", "time_interval").collect()
    }


def at(seconds):
    return round(seconds * 1_000_000)


def test_boundary_is_inclusive(spark):
    rows = [(i, "c", "e.com", s, at(t)) for i, (t, s) in enumerate([(0, "one"), (30, "two"), (60, "one"), (61, "three")])]
    got = measured(with_window_features(table(spark, rows)))
    assert [got[i][:2] for i in range(4)] == [(1, 1), (2, 2), (3, 2), (3, 3)]


def test_interval_is_kept_per_group(spark):
    rows = [(0, "a", "e.com", "x", at(10)), (1, "a", "o.com", "x", at(12)), (2, "a", "e.com", "x", at(17.5)), (3, "b", "e.com", "x", at(20))]
    got = measured(with_window_features(table(spark, rows)))
    assert [got[i][2] for i in range(4)] == [-1.0, -1.0, 7.5, -1.0]


def test_interval_reaches_past_the_window(spark):
    rows = [(i, "a", "e.com", "x", at(t)) for i, t in enumerate([0, 30, 60, 125])]
    got = measured(with_window_features(table(spark, rows)))
    assert [got[i][0] for i in range(4)] == [1, 2, 3, 1]
    assert got[3][2] == 65.0


def test_features_are_causal(spark):
    rows = [(i, "a", "e.com", "x", at(t)) for i, t in enumerate([0, 30, 61])]
    got = measured(with_window_features(table(spark, rows)))
    assert [got[i][0] for i in range(3)] == [1, 2, 2]
    fresh = measured(with_window_features(table(spark, rows[1:])))
    assert fresh[1] == (1, 1, -1.0)


@pytest.mark.parametrize("layout", [Layout(False), Layout(True, 7)], ids=["groups", "chunks"])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_with_ties_and_a_hot_group(spark, layout, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        hot = rng.random() < 0.6
        src, apex = ("hot", "hot.com") if hot else (f"c{rng.randrange(4)}", f"d{rng.randrange(3)}.com")
        when = at(rng.choice([rng.randrange(0, 400), rng.randrange(0, 40) * 10, 77]))
        rows.append((i, src, apex, rng.choice(["", "a", "b", "c", "d"]), when))
    got = measured(with_window_features(table(spark, rows), layout=layout))
    assert got == brute_force(rows, at(60))


def test_one_instant_holds_most_rows(spark):
    rows = [(i, "a", "e.com", f"s{i % 9}", at(5)) for i in range(300)] + [(300 + i, "a", "e.com", "z", at(70 + i)) for i in range(5)]
    got = measured(with_window_features(table(spark, rows), limit=50))
    assert got == brute_force(rows, at(60))


def test_capture_separates_histories(spark):
    rows = table(spark, [(i, "a", "e.com", "x", at(i)) for i in range(6)]).withColumn("capture_id", F.col("row_id") % 2)
    got = measured(with_window_features(rows, keys=("capture_id", "src_ip", "apex_domain")))
    assert [got[i][0] for i in range(6)] == [1, 1, 2, 2, 3, 3]


def test_window_must_be_positive(spark):
    with pytest.raises(ValueError):
        with_window_features(table(spark, []), window_seconds=0)


def test_order_violation_is_refused(spark):
    good = table(spark, [(0, "a", "e.com", "x", at(10)), (1, "a", "e.com", "x", at(10)), (2, "b", "e.com", "x", at(9))])
    assert require_chronological(good) is good
    with pytest.raises(DataError):
        require_chronological(table(spark, [(0, "a", "e.com", "x", at(10)), (1, "a", "e.com", "x", at(9))]))


def test_retime_puts_fixed_gaps(spark):
    rows = [(1, "a", "x.net", "a1", at(100)), (2, "a", "x.net", "a2", at(107)), (3, "b", "y.net", "b1", at(101)), (4, "a", "x.net", "a3", at(150))]
    got = {r.row_id: r.epoch_us for r in retime(table(spark, rows), 5000, 1_700_000_000_000_000).collect()}
    assert got == {1: 1_700_000_000_000_000, 2: 1_700_000_000_005_000, 4: 1_700_000_000_010_000, 3: 1_700_000_000_000_000}


def test_chunked_running_values_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, rng.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string, v int")
    values = dict(
        s=running_sum(F.coalesce("v", F.lit(0))), p=previous(F.col("v")), f=following(F.col("v")),
        k=last_known(F.col("v")), m=highest_before(F.col("v")),
    )
    for group in (["g"], []):
        plain = with_running(df, group, ["i"], Layout(False), **values)
        cut = with_running(df, group, ["i"], Layout(True, 9), **values)
        assert len(cut.collect()) == len(rows)
        assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in cut.collect()}


def test_sums_over_nulls_do_not_depend_on_the_layout(spark):
    from leakgauge.plans.ordered import running_sum, with_running

    rows = [("a", i, v) for i, v in enumerate([None, 1, None, None, None, 2, None, None])] + [("b", i, None) for i in range(8)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    plain, cut = (
        {(r.g, r.i): r.s for r in with_running(df, ["g"], ["i"], limit=limit, s=running_sum(F.col("v"))).collect()} for limit in (100, 2)
    )
    assert plain == cut and plain["a", 0] is None and plain["a", 4] == 1 and plain["b", 7] is None


def test_chunks_follow_the_rows_and_nothing_runs_before_the_query(spark):
    """Borders depend on contents alone: any partitioning gives the same chunks, nothing is written, no job runs early."""
    from leakgauge.plans import ordered

    rows = [(f"g{i % 11 if i % 3 else 0}", i * 7919 % 5000, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, t long, i long")
    spark.sparkContext.setJobGroup("early", "early")
    cut = with_running(df, ["g"], ["t", "i"], limit=100, s=running_sum(F.col("i")))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("early")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    borders = [
        {r["__h0"]: r["__borders"] for r in ordered.group_borders(d, ["g"], ["t", "i"], 100).collect()} for d in (df, df.repartition(7))
    ]
    assert borders[0] == borders[1] and len(borders[0]["g0"]) > len(borders[0]["g1"]) > 4
    plain = with_running(df, ["g"], ["t", "i"], ordered.Layout(False), s=running_sum(F.col("i")))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    assert "Checkpoint" not in cut._jdf.queryExecution().toString()


def test_no_row_carries_all_borders_of_its_group(spark):
    """Two levels of about the root of the borders each; the chunks are those of one list of all of them."""
    from leakgauge.plans import ordered

    rows = [(f"g{i % 3}" if i % 50 else None, i * 7919 % 6000, i) for i in range(6000)] + [("cold", 1, -1), ("cold", 2, -2)]
    df = spark.createDataFrame(rows, "g string, t long, i long")
    hot = ordered.group_borders(df, ["g"], ["t", "i"], 16).persist()
    tops, leaves = ordered._levels(hot, ["g"])
    most = hot.agg(F.max(F.size("__borders"))).first()[0]
    assert most > 500 and tops.agg(F.max(F.size("__tops"))).first()[0] < 2 * most ** 0.5 and leaves.agg(F.max(F.size("__leaf"))).first()[0] < 2 * most ** 0.5
    borders = {r["__h0"]: [tuple(b) for b in r["__borders"]] for r in hot.collect()}
    got = ordered._with_chunk(df, ["g"], ["t", "i"], hot).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["__hot"] == (r["g"] in borders)
        assert r["__chunk"] == sum(b <= (r["t"], r["i"]) for b in borders.get(r["g"], ()))


def test_whole_groups_if_no_part_of_a_large_source_is_over_the_limit(spark):
    from leakgauge.plans.ordered import Layout, layout_if_small

    source = spark.range(100)
    assert layout_if_small(source, 99) is None
    assert layout_if_small(source, 25, F.col("id") % 4) == Layout(False)
    assert layout_if_small(source, 24, F.col("id") % 4) is None
