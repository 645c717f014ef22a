"""Quality classifier: Naive Bayes support vectors.

Indicators of a text's n-grams (of bytes, and of marks whether a word repeats the one before) are scaled by the ratio of
the classes' log counts, and a linear hinge-loss model is fitted on them by dual coordinate descent. Margins become
probabilities by a logistic curve fitted on rows that the descent did not see.

The model learns from at most `FIT_ROWS` labelled rows, drawn by a hash of the identifier from the rows whose crc32
remainder is not 0; every text is scored whole.

Defined cases: a null text scores like an empty one; rows without a label, or with a null one, teach nothing; a document
with several labels teaches the lowest; without rows of both classes every score is the share of label 1 (0.5 without
rows); repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ngrams import indicators
from .store import narrow, sql_crc_fold

FIT_ROWS, BITS, LONGEST, ROUNDS, PENALTY, THRESHOLD = 12_000, 17, 3, 10, 1.0, 0.3


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, places):
        r = self.ratio[places]
        return float(self.weight[places] @ r) / max(float(np.sqrt(r @ r)), 1e-9) + self.bias

    def score(self, text):
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text, LONGEST, BITS)) + self.offset, -500, 500))))


def log_count_ratios(rows, good):
    """Per place: log of its share among the n-grams of good texts over that of bad texts, each count raised by one."""
    counts = np.ones((2, 1 << BITS))
    for places, y in zip(rows, good):
        counts[int(y)][places] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(rows, signs, ratio, rounds=ROUNDS, penalty=PENALTY, seed=1):
    """Linear hinge loss with a bias: one dual variable at a time, clipped to [0, penalty]."""
    values = [ratio[p] / max(np.sqrt(ratio[p] @ ratio[p]), 1e-9) for p in rows]
    weight, bias, duals = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            x, p, y = values[i], rows[i], signs[i]
            slack = y * (weight[p] @ x + bias) - 1
            new = min(max(duals[i] - slack / (x @ x + 1), 0.0), penalty)
            if step := (new - duals[i]) * y:
                weight[p] += step * x
                bias += step
                duals[i] = new
    return weight, bias


def logistic_curve(margins, good, steps=100):
    """Slope and offset by Newton's method, with targets drawn in a little, so that separable rows have an optimum."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)])
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        theta -= np.clip(step, -5, 5)
    return theta


def fit(rows, good):
    """A model from lists of places and their labels."""
    good = np.asarray(good, bool)
    if good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratios(rows, good)
    aside = np.arange(len(rows)) % 5 == 4
    if len(set(good[aside])) < 2 or len(set(good[~aside])) < 2:
        aside[:] = False
    learn = np.flatnonzero(~aside)
    weight, bias = dual_descent([rows[i] for i in learn], np.where(good[learn], 1.0, -1.0), ratio)
    model = Model(ratio.astype(np.float32), weight.astype(np.float32), float(bias), 1.0, 0.0)
    checked = np.flatnonzero(aside) if aside.any() else learn
    model.slope, model.offset = map(float, logistic_curve(np.array([model.margin(rows[i]) for i in checked]), good[checked]))
    return model


def _fit_in_task(batches):
    drawn = []
    for batch in batches:
        drawn += zip(batch.column("draw").to_pylist(), batch.column("places").to_pylist(), batch.column("quality").to_pylist())
    drawn.sort()
    model = fit([np.frombuffer(p, np.int32) for _, p, _ in drawn], [y > 0 for *_, y in drawn])
    yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})


def _places(batches):
    for batch in batches:
        found = [indicators(t or "", LONGEST, BITS).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"draw": batch.column("draw"), "quality": batch.column("quality"), "places": pa.array(found, pa.binary())})


def fitted(docs, labels, rows=FIT_ROWS, id_col="doc_id", text_col="text"):
    """Fit on a bounded sample, in one task whose input is bounded by `rows`. The sample's identifiers are the only
    thing that is broadcast, and bounded alike."""
    ids = narrow(labels, label_id="doc_id", quality="quality").where("label_id is not null and quality is not null")
    ids = ids.where(sql_crc_fold(F.col("label_id")) != 0).groupBy("label_id").agg(F.min("quality").alias("quality"))
    drawn = ids.withColumn("draw", F.xxhash64("label_id")).orderBy("draw", "label_id").limit(rows)
    texts = narrow(docs, doc_id=id_col, text=text_col)
    sample = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("draw", "text", "quality")
    places = sample.mapInArrow(_places, "draw long, quality int, places binary")
    (row,) = places.repartition(1).mapInArrow(_fit_in_task, "model binary").collect()
    return pickle.loads(row.model)


def scorer(model):
    """A column function from texts to scores."""
    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype="float64")

    return scored


def quality_scores(docs, labels, rows=FIT_ROWS, id_col="doc_id", text_col="text"):
    """Per document: whether it was held out, its score, and the predicted label."""
    score = scorer(fitted(docs, labels, rows, id_col, text_col))
    texts = narrow(docs, doc_id=id_col, text=text_col)
    return texts.select("doc_id", (sql_crc_fold(F.col("doc_id")) == 0).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
