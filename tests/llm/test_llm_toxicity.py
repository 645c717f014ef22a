"""Toxicity: held-out accuracy, ratios, the optimum of the fit, awkward rows."""

import zlib

import numpy as np
import pytest

from leakgauge.llm import toxicity
from leakgauge.llm.store import table


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def test_held_out_rows(spark):
    larger = "/root/testdata/sf0.1"
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    held = [(rows[r.doc_id], r.toxic) for r in labels.collect() if fold(r.doc_id) == 0]
    assert np.mean([r.predicted == t for r, t in held]) >= 0.96
    assert np.mean([r.predicted for r, t in held if not t]) <= 0.005
    assert np.mean([r.predicted for r, t in held if t]) >= 0.75
    scores, toxic = np.array([r.score for r, _ in held]), np.array([t > 0 for _, t in held])
    assert np.mean(scores[toxic][:, None] > scores[~toxic][None]) >= 0.97


def test_ignores_held_out_labels_and_reruns_alike(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    score = lambda l, d=docs: sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(d, l).collect())
    first = score(labels)
    assert first == score(flipped) == score(labels.repartition(5), docs.repartition(4))


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (3, None, 1), (4, 1, 1)], "doc_id long, toxic int, text int")
    rows = toxicity.toxicity_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    one = labels.where("toxic = 1")
    assert {round(r.score, 6) for r in toxicity.toxicity_scores(awkward, one).collect()} == {1.0}
    assert {r.score for r in toxicity.toxicity_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(awkward, labels.withColumn("doc_id", labels.doc_id + 10**6)).collect()} == {0.5}
    assert toxicity.toxicity_scores(nothing, labels).count() == 0


def plain_grams(text):
    spaced = " " + " ".join(text.lower().split()) + " "
    return {(n, spaced[i:i + n]) for n in range(2, toxicity.LONGEST + 1) for i in range(len(spaced) - n + 1) if " " not in spaced[i + 1:i + n - 1]}


def test_places_are_the_grams_of_the_whole_text(monkeypatch):
    for text in ("You IDIOT", "é日本 テキスト\n\x0bx", "", " ", "a"):
        assert len(toxicity.char_places(text)) == len(plain_grams(text))
    long = " ".join(f"w{i % 97}x{i % 31}" for i in range(3000))
    whole = toxicity.char_places(long)
    monkeypatch.setattr(toxicity, "RUN", 50)
    assert (toxicity.char_places(long) == whole).all()


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 8, replace=False)).astype(np.int32) for _ in range(60)] + [np.zeros(0, np.int32)]
    toxic, ratio, weight = rng.random(61) < 0.4, rng.normal(size=1 << toxicity.BITS), rng.random(61) + 0.5
    loss = toxicity.Loss(rows, toxic, ratio, weight)
    x = np.zeros((61, 41))
    for r, p in zip(x, rows):
        r[np.searchsorted(loss.places, p)] = ratio[p]
    x[:, 40] = 1
    plain = lambda t: weight @ np.logaddexp(0, -np.where(toxic, 1, -1) * (x @ t)) + toxicity.PENALTY / 2 * t[:-1] @ t[:-1]
    theta = toxicity.minimised(loss, np.zeros(41), steps=500)
    assert loss(theta)[0] == pytest.approx(plain(theta))
    assert all(plain(theta + rng.normal(size=41) * s) >= plain(theta) - 1e-6 for s in (0.3, 0.03, 0.003) for _ in range(200))


def test_ratios_are_log_count_ratios():
    ratio = toxicity.ratios([np.array([1, 2]), np.array([1]), np.array([3])], [True, True, False])
    assert ratio[1] == pytest.approx(np.log((3 / 4) / (1 / 3)))
    assert ratio[3] == pytest.approx(np.log((1 / 4) / (2 / 3)))
    assert ratio[4] == 0
