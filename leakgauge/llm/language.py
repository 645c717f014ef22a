"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a linear logistic classifier over the shares of byte n-grams predicts it. A
text gets the language whose codeword has the least logistic loss over all bits, each bit weighted by how well its
classifier separates, and is flagged as ambiguous where the second language comes close.

Up to `EXHAUSTIVE` languages all distinct splits are bits; beyond, random splits are drawn and the draw with the largest
least distance between codewords is taken. Languages are those of the training rows (crc32 remainder not 0); the
classifiers learn from at most about `FIT_ROWS` of them, drawn evenly over the languages by a hash of the identifier.

Defined cases: a null text or one without a letter is `und` with score 0; if no training row has a language all are
`und`; with one language every text with a letter has it; rows with a null lang or a null identifier teach nothing;
repeated rows are predicted each; an empty table gives no rows; other columns are ignored.
"""

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .ngrams import shares
from .store import narrow, sql_crc_fold

FIT_ROWS, BITS, LONGEST, EXHAUSTIVE, DRAWS, ROUNDS, BATCH = 6000, 12, 3, 6, 40, 60, 256
#: A text is ambiguous if the chosen language's share of the decoded weight is below this.
CLEAR = 0.6


def codewords(classes, seed=9):
    """A matrix of +1 and -1, a row per class, whose columns split the classes."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= EXHAUSTIVE:
        splits = range(1, 1 << (classes - 1))
        return np.array([[1 if c and s >> (c - 1) & 1 else -1 for s in splits] for c in range(classes)], float)
    rng, width, best = np.random.default_rng(seed), math.ceil(10 * math.log2(classes)), None
    for _ in range(DRAWS):
        code = rng.choice([-1.0, 1.0], (classes, width))
        code[0] *= np.where(np.abs(code.sum(axis=0)) == classes, -1, 1)  # a column that splits nothing
        near = code @ code.T
        np.fill_diagonal(near, -width)
        if best is None or near.max() < best[0]:
            best = near.max(), code
    return best[1]


@dataclass
class Model:
    languages: list
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, text):
        if not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        outputs = shares(text.lower(), LONGEST, BITS) @ self.weight + self.bias
        losses = np.logaddexp(0, -self.code * outputs) @ self.trust
        odds = np.exp(losses.min() - losses)
        share = float(odds.max() / odds.sum())
        return self.languages[int(np.argmin(losses))], share, share < CLEAR


def fit(vectors, labels, rate=20.0, decay=1e-5, seed=2):
    """All bits' classifiers at once, by mini-batches; an accuracy near chance takes a bit's weight away."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((1 << BITS, 1)), np.zeros(1), np.ones(1))
    code = codewords(len(languages))
    at = {name: i for i, name in enumerate(languages)}
    x, y = np.asarray(vectors, np.float32), code[[at[v] for v in labels]].astype(np.float32)
    weight, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    rng = np.random.default_rng(seed)
    for turn in range(ROUNDS):
        for part in np.array_split(rng.permutation(len(x)), -(-len(x) // BATCH)):
            pull = y[part] / (1 + np.exp(np.clip(y[part] * (x[part] @ weight + bias), -30, 30)))
            step = rate / (1 + turn / 10) / len(part)
            weight += step * (x[part].T @ pull) - rate * decay * weight
            bias += 0.1 * step * pull.sum(axis=0)
    right = (np.sign(x @ weight + bias) == y).mean(axis=0)
    return Model(languages, code, weight, bias, np.clip(2 * right - 1, 0.01, 1))


def _fit_in_task(batches):
    drawn = []
    for batch in batches:
        drawn += zip(batch.column("draw").to_pylist(), batch.column("lang").to_pylist(), batch.column("vector").to_pylist())
    drawn.sort(key=lambda r: r[:2])
    model = fit([np.frombuffer(v, np.float32) for *_, v in drawn], [lang for _, lang, _ in drawn])
    yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})


def _vectors(batches):
    for batch in batches:
        vectors = [shares((t or "").lower(), LONGEST, BITS).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"draw": batch.column("draw"), "lang": batch.column("lang"), "vector": pa.array(vectors, pa.binary())})


def fitted(docs, rows=FIT_ROWS, id_col="doc_id", text_col="text", lang_col="lang"):
    """Count the languages over all training rows, draw about rows / languages of each, fit in one bounded task."""
    train = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col).where("doc_id is not null and text is not null and lang is not null")
    train = train.where(sql_crc_fold(F.col("doc_id")) != 0).withColumn("draw", F.xxhash64("doc_id"))
    counts = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    part, place = rows / max(1, len(counts)), (F.pmod("draw", F.lit(1 << 30)) / (1 << 30))
    rate = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, part / n))) if counts else F.lit(None).cast("map<string,double>")
    sample = train.where(place < F.element_at(rate, F.col("lang"))).select("draw", "lang", "text")
    vectors = sample.mapInArrow(_vectors, "draw long, lang string, vector binary")
    (row,) = vectors.repartition(1).mapInArrow(_fit_in_task, "model binary").collect()
    return pickle.loads(row.model)


def languages(docs, rows=FIT_ROWS, id_col="doc_id", text_col="text", lang_col="lang"):
    """Per document: whether it was held out, predicted language, score, and whether the decoding was ambiguous."""
    model = fitted(docs, rows, id_col, text_col, lang_col)

    def predicted(batches):
        for batch in batches:
            found = [model.predict(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64()),
                "ambiguous": pa.array([f[2] for f in found], pa.bool_()),
            })

    texts = narrow(docs, doc_id=id_col, text=text_col).withColumn("held_out", sql_crc_fold(F.col("doc_id")) == 0)
    return texts.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
