"""Toxicity: a linear classifier of character n-grams that are scaled by naive Bayes log-count ratios.

A text is lower-cased and cut into words; the indicators of the character n-grams of 2 to 6 characters inside words, the
spaces around a word included, are scaled by the log of the ratio of their shares in toxic and in clean texts. Weights
and bias minimise the logistic loss with a squared penalty, so scores are probabilities. A word that betrays a text
counts the same in a long text as in a short one, because indicators are not divided by the text's length.

The model learns from at most `FIT_ROWS` labelled rows of each class and at most `FIT_PLACES` n-grams altogether, drawn by
a hash of the identifier from the rows whose crc32 remainder is not 0; rows count so that the classes keep their shares.
Every text is scored whole.

Defined cases: a null text scores like an empty one, by the bias alone; rows without a label, or with a null one, teach
nothing; a document with several labels teaches the highest; rows that share an
identifier are scored each and teach once, by the least of their texts; tied draws go by identifier; without rows of both classes every score is the share of toxic rows (0.5
without rows); an empty table gives no rows; other columns are ignored.
"""

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .store import narrow, sql_crc_fold

FIT_ROWS, FIT_PLACES, BITS, LONGEST = 4_000, 12_000_000, 18, 6
PENALTY, STEPS, MEMORY, THRESHOLD = 1.0, 60, 8, 0.5
#: N-grams of a smaller share of the drawn rows carry no weight: they would only memorise wrong labels.
LEAST_SHARE = 0.003
#: Characters of a text that are hashed at a time.
RUN = 1 << 17
_FACTOR, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def char_places(text):
    """Sorted places of the character n-grams that occur in a text; n-grams go over no word's border."""
    mark = np.zeros(1 << BITS, bool)
    spaced = " " + " ".join((text or "").lower().split()) + " "
    for start in range(0, len(spaced) - 1, RUN):
        codes = np.frombuffer(spaced[start:start + RUN + LONGEST - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        spaces = np.cumsum(codes == 32)
        rolling = codes.copy()
        for n in range(2, min(LONGEST, len(codes)) + 1):
            rolling = rolling[:-1] * _FACTOR + codes[n - 1:]
            inside = spaces[n - 2:len(codes) - 1] == spaces[:len(codes) - n + 1]
            mixed = (rolling[inside] + np.uint64(n)) * _MIX
            mixed ^= mixed >> np.uint64(31)
            mark[((mixed * _FACTOR) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(mark).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, text):
        margin = float(self.weight[char_places(text)].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def ratios(rows, toxic):
    """Per place: log of the share of toxic texts that have it over that of clean ones, each count raised by one; 0 for rare places."""
    counts = np.zeros((2, 1 << BITS))
    for places, y in zip(rows, toxic):
        counts[int(y)][places] += 1
    share = (counts + 1) / (np.bincount(np.asarray(toxic, int), minlength=2)[:, None] + 2)
    return np.where(counts.sum(axis=0) >= LEAST_SHARE * len(rows), np.log(share[1] / share[0]), 0.0)


class Loss:
    """Weighted logistic loss plus PENALTY / 2 times the squared weights, and its gradient; the bias is free."""

    def __init__(self, rows, toxic, ratio, row_weight):
        rows = [r[ratio[r] != 0] for r in rows]
        self.places, used = np.unique(np.concatenate(rows), return_inverse=True)
        self.used = used.astype(np.int32)
        self.size = np.array([len(r) for r in rows])
        self.starts = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.ratio, self.sign = ratio[self.places], np.where(toxic, 1.0, -1.0)
        self.row_weight = row_weight

    def margins(self, theta):
        scaled = np.append((theta[:-1] * self.ratio)[self.used], 0.0)
        sums = np.add.reduceat(scaled, np.minimum(self.starts, len(scaled) - 1))
        return np.where(self.size > 0, sums, 0.0) + theta[-1]

    def __call__(self, theta):
        z = self.sign * self.margins(theta)
        slope = -self.row_weight * self.sign / (1 + np.exp(np.clip(z, -500, 500)))
        down = np.bincount(self.used, np.repeat(slope, self.size), len(self.places)) * self.ratio + PENALTY * theta[:-1]
        value = self.row_weight @ np.logaddexp(0, -z) + PENALTY / 2 * (theta[:-1] @ theta[:-1])
        return value, np.append(down, slope.sum())


def minimised(loss, start, steps=STEPS, memory=MEMORY):
    """Limited-memory quasi-Newton steps with backtracking."""
    theta, kept = start, []
    value, slope = loss(theta)
    for _ in range(steps):
        step, used = slope.copy(), []
        for s, y in reversed(kept):
            used.append((s @ step) / (s @ y))
            step -= used[-1] * y
        if kept:
            s, y = kept[-1]
            step *= (s @ y) / (y @ y)
        for (s, y), a in zip(kept, reversed(used)):
            step += s * (a - (y @ step) / (s @ y))
        length, fall = (1.0 if kept else 1 / max(np.linalg.norm(slope), 1e-12)), slope @ step
        while length > 1e-10:
            new = theta - length * step
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        if (new - theta) @ (new_slope - slope) > 1e-12:
            kept = [*kept[-memory + 1:], (new - theta, new_slope - slope)]
        done = value - new_value <= 1e-7 * abs(value)
        theta, value, slope = new, new_value, new_slope
        if done:
            break
    return theta


def fit(rows, toxic, shares=None):
    """A model from lists of places and their labels; `shares` are all labelled rows of the two classes, clean first."""
    toxic = np.asarray(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        share = min(max(float(toxic.mean()) if len(toxic) else 0.5, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    ratio = ratios(rows, toxic)
    drawn = np.array([(~toxic).sum(), toxic.sum()])
    by_class = np.asarray(drawn if shares is None else shares) / drawn
    loss = Loss(rows, toxic, ratio, (by_class / by_class.min())[toxic.astype(int)])
    theta = minimised(loss, np.zeros(len(loss.places) + 1))
    weight = np.zeros(1 << BITS, np.float32)
    weight[loss.places] = theta[:-1] * loss.ratio
    return Model(weight, float(theta[-1]))


def _fit_in_task(batches):
    rows, toxic, shares, held = [], [], {}, 0
    for batch in batches:
        for places, y, n in zip(batch.column("places"), batch.column("toxic").to_pylist(), batch.column("in_class").to_pylist()):
            shares[y] = n
            if held <= FIT_PLACES:
                rows.append(np.frombuffer(places.as_py(), np.int32))
                toxic.append(y > 0)
                held += len(rows[-1])
    model = fit(rows, toxic, [shares[0], shares[1]] if len(shares) == 2 else None)
    yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})


def _places(batches):
    for batch in batches:
        found = [char_places(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch({c: batch.column(c) for c in ("label_id", "draw", "toxic", "in_class")} | {"places": pa.array(found, pa.binary())})


def fitted(docs, labels, rows=FIT_ROWS, id_col="doc_id", text_col="text"):
    """Fit on a bounded sample in one task, which takes rows in the order of their draw until the bound on n-grams."""
    known = narrow(labels, label_id="doc_id", toxic="toxic").where("label_id is not null and toxic is not null")
    known = known.where(sql_crc_fold(F.col("label_id")) != 0).groupBy("label_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("draw", F.xxhash64("label_id"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    parts = [
        known.where(F.col("toxic") == y).orderBy("draw", "label_id").limit(rows).withColumn("in_class", F.lit(n).cast("long"))
        for y, n in sorted(counts.items())
    ] or [known.withColumn("in_class", F.lit(0).cast("long"))]
    drawn = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = narrow(docs, doc_id=id_col, text=text_col)
    found = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).groupBy("label_id", "draw", "toxic", "in_class").agg(F.min("text").alias("text"))
    places = found.mapInArrow(_places, "label_id long, draw long, toxic int, in_class long, places binary")
    models = places.repartition(1).sortWithinPartitions("draw", "label_id").mapInArrow(_fit_in_task, "model binary").collect()
    return pickle.loads(models[0].model) if models else fit([], [])


def scorer(model):
    """A column function from texts to scores."""
    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored


def toxicity_scores(docs, labels, rows=FIT_ROWS, id_col="doc_id", text_col="text"):
    """Per document: whether it was held out, its score, and the predicted label."""
    score = scorer(fitted(docs, labels, rows, id_col, text_col))
    texts = narrow(docs, doc_id=id_col, text=text_col)
    return texts.select("doc_id", (sql_crc_fold(F.col("doc_id")) == 0).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
