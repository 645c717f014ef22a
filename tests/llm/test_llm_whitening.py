"""Whitening against a dense decomposition, and the iteration on awkward spectra."""

import math

import numpy as np
import pytest

from leakgauge.llm import whitening
from leakgauge.llm.store import table


def plain(rows):
    """Remaining (id, x) and the dense answer over the distinct x."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (d - len(v)) for _, v in kept], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(d, d))
    return kept, n, deviation, values[::-1], vectors[:, ::-1], x.astype(float) - sums / n


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "'v' as v", "2 as component")
    got = whitening.whitened(df.repartition(3)).collect()
    kept, n, deviation, values, vectors, centred = plain(rows)
    k = min(4, len(values))
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got) == sorted(
        (i, c + 1, n, dev) for (i, _), dev in zip(kept, deviation) for c in range(k))
    for c in range(k):
        mine = [r for r in got if r.component == c + 1]
        want = {i: w for (i, _), w in zip(kept, centred @ vectors[:, c] / math.sqrt(values[c]))} if values[c] > 1e-9 else {}
        sign = None
        for r in mine:
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9, abs=1e-12)
            if not want:
                assert r.whitened is None
            elif abs(want[r.vec_id]) > 1e-6:
                sign = sign or math.copysign(1, r.whitened * want[r.vec_id])
                assert r.whitened * sign == pytest.approx(want[r.vec_id], abs=1e-8)
        assert not mine or mine[0].identity_error is None or mine[0].identity_error < 1e-9


def test_given_vectors_with_awkward_rows(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    rows += [(9001, None), (9002, [None] * 64), (9003, [float("nan")] * 64), (9004, [float("inf")] + [0.0] * 63),
             (9005, [-float("inf")] + [0.0] * 63), rows[3], rows[3], (9006, rows[5][1]), (9007, []), (9008, [0.5, -0.5]), (9009, [-0.0] * 64)]
    check(spark, rows)


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_few_dimensions(spark, d):
    rng = np.random.default_rng(d)
    check(spark, [(i, [float(c) for c in rng.normal(size=d) * np.arange(1, d + 1)]) for i in range(40)])


def test_few_vectors_and_none(spark):
    check(spark, [(1, [0.5, 0.25, 1.0, 2.0, 3.0]), (2, [0.5, 0.75, 1.5, 2.0, -3.0])])
    one = whitening.whitened(spark.createDataFrame([(1, [0.5] * 6), (2, [0.5] * 6)], "vec_id long, embedding array<float>")).collect()
    assert len(one) == 8 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in one)
    for none in ([], [(1, None)], [(1, [])]):
        df = whitening.whitened(spark.createDataFrame(none, "vec_id long, embedding array<float>"))
        assert df.count() == 0 and df.columns[:3] == ["vec_id", "component", "n"]


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(2 ** 40 * (i % 3)), float(i)]) for i in range(9)]
    got = {r.vec_id: r.deviation for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == set(range(9)) and None in got.values()


@pytest.mark.parametrize("values", [
    np.arange(100.0)[::-1] ** 2, np.concatenate([np.full(3, 5.0), np.full(2, 4.999999), np.arange(60) / 20]),
    np.concatenate([[1.0, 1e-3, 1e-6, 1e-9], np.zeros(40)]), np.zeros(9), np.ones(12), np.array([2.0]),
])
def test_pairs_reach_double_precision(values):
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    a = (turn * values) @ turn.T
    a = (a + a.T) / 2
    found, vectors = whitening.leading_pairs(lambda b: a @ b, len(values))
    scale = max(values.max(), 1e-300)
    assert np.abs(found - np.sort(values)[::-1][:4]).max() <= 1e-13 * scale
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13
