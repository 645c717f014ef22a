"""Classifiers: held-out accuracy, the descent's optimum, decoding."""

import zlib

import numpy as np
import pytest

from leakgauge.llm import language, quality
from leakgauge.llm.store import table


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def test_quality_on_held_out_rows(spark, larger):
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if fold(r.doc_id) == 0]
    assert np.mean([r.predicted == q for r, q in held]) >= 0.93
    assert np.mean([r.predicted for r, q in held if q]) >= 0.97


def test_quality_ignores_held_out_labels_and_reruns_alike(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    score = lambda l, d=docs: sorted((r.doc_id, r.score) for r in quality.quality_scores(d, l).collect())
    first = score(labels)
    assert first == score(flipped) == score(labels.repartition(5), docs.repartition(4))


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (3, None, 1), (4, 1, 1)], "doc_id long, quality int, text int")
    rows = quality.quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    one = labels.where("quality = 1")
    assert {round(r.score, 6) for r in quality.quality_scores(awkward, one).collect()} == {1.0}
    assert {r.score for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 8, replace=False)).astype(np.int32) for _ in range(60)]
    ratio, signs = rng.normal(size=40), rng.choice([-1.0, 1.0], 60)
    weight, bias = quality.dual_descent(rows, signs, ratio, rounds=400)
    x = np.zeros((60, 41))
    for r, p in zip(x, rows):
        r[p] = ratio[p] / np.sqrt(ratio[p] @ ratio[p])
        r[40] = 1
    w = np.append(weight, bias)
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - signs * (x @ w)).sum()
    best = loss(w)
    assert all(loss(w + rng.normal(size=41) * s) >= best - 1e-6 for s in (0.3, 0.03, 0.003) for _ in range(200))


def test_ratios_are_log_count_ratios():
    ratio = quality.log_count_ratios([np.array([1, 2]), np.array([1]), np.array([3])], [True, True, False])
    total = 1 << quality.BITS
    assert ratio[1] == pytest.approx(np.log((3 / (total + 3)) / (1 / (total + 1))))
    assert ratio[3] == pytest.approx(np.log((1 / (total + 3)) / (2 / (total + 1))))


def test_languages_on_held_out_rows(spark, larger):
    docs = table(spark, larger, "documents")
    rows = {r.doc_id: r for r in language.languages(docs).collect()}
    held = [(rows[r.doc_id].lang_pred, r.lang) for r in docs.collect() if fold(r.doc_id) == 0]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 for i, r in rows.items())


def test_languages_of_awkward_rows(spark, awkward, awkward_rows, nothing):
    rows = language.languages(awkward).collect()
    known = {lang for i, t, lang, *_ in awkward_rows if lang and t is not None and i is not None and fold(i)}
    no_letter = {i for i, t, *_ in awkward_rows if not any(map(str.isalpha, t or ""))}
    assert len(rows) == len(awkward_rows)
    for r in rows:
        if r.doc_id is not None:
            assert (r.lang_pred == "und" and r.score == 0) if r.doc_id in no_letter else r.lang_pred in known
    one = awkward.where("lang = 'en'")
    assert {r.lang_pred for r in language.languages(one).collect()} <= {"en", "und"}
    assert {r.lang_pred for r in language.languages(awkward.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert language.languages(nothing).count() == 0


@pytest.mark.parametrize("classes", [2, 3, 4, 6, 7, 40])
def test_codewords_are_far_apart(classes):
    code = language.codewords(classes)
    distance = (code[:, None] != code[None]).sum(axis=2) + np.eye(classes, dtype=int) * 10**6
    assert distance.min() >= (1 if classes == 2 else code.shape[1] // 4)
    assert all(len(set(column)) == 2 for column in code.T)


def test_decoding_survives_a_wrong_bit():
    code = language.codewords(6)
    model = language.Model(list("abcdef"), code, np.zeros((1 << language.BITS, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    for c in range(6):
        outputs = code[c] * 4
        outputs[c] *= -1
        model.bias = outputs
        assert model.predict("text")[0] == "abcdef"[c]
    model.bias = np.zeros(code.shape[1])
    assert model.predict("text")[2]
