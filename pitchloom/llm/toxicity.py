"""Operator 2: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (3 to 6, word ends marked) of a text's distinct lower-cased words, hashed into BUCKETS; a feature's value is the number
of distinct words that hold it, times the log ratio of its smoothed document counts in toxic and other training texts. Weights come from
logistic regression with L2 penalty on these values. As the model is linear, a text's score is the sum of its words' scores, which
are remembered.

The model is fitted on at most `sample` labelled rows that are not held out, chosen by a hash of doc_id: a documented bound. Every text is
scored. Defined results: null or empty text: no features, the score is the model's intercept. Texts without labels are scored like others. No usable
label: every score is 0.5 and nothing is predicted. Repeated rows: scored each. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
LEAST_TEXTS = 4
#: Features whose two document rates are closer than this (log ratio) tell too little to be kept.
LEAST_RATIO = 0.3
SMOOTHING = 1.0
PENALTY = 1e-4
ROUNDS = 80
SAMPLE = 4000
THRESHOLD = 0.7
EDGES = " .,;:!?\"'()[]|*#$%&<>"
REMEMBERED = 500_000


def words(text: str) -> set[str]:
    return {w.strip(EDGES) for w in set(text.lower().split())} - {""}


def features(word: str) -> list[int]:
    """The buckets of a word's n-grams, each once."""
    s = f"^{word}$"
    grams = {s[i : i + n] for n in SIZES for i in range(len(s) - n + 1)}
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.weights, self.intercept)

    def word(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = self.known[w] = float(self.weights[features(w)].sum())
        return got

    def score(self, text: str) -> float:
        z = self.intercept + sum(sorted(map(self.word, words(text))))
        return 1 / (1 + np.exp(-min(max(z, -40.0), 40.0)))


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Logistic regression by full-batch gradient steps (Adam), from zero weights: the same rows give the same model."""
    y = np.array(toxic, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    cells = []
    for t in texts:
        found, times = np.unique(np.fromiter((f for w in words(t) for f in features(w)), dtype=np.int32), return_counts=True)
        cells.append((found, times.astype(np.float32)))
    seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for (found, _), k in zip(cells, toxic, strict=True):
        seen[k][found] += 1
    ratio = np.log((seen[1] + SMOOTHING) / (y.sum() + SMOOTHING)) - np.log((seen[0] + SMOOTHING) / ((1 - y).sum() + SMOOTHING))
    ratio[(seen[0] + seen[1] < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    good = [ratio[c] != 0 for c, _ in cells]
    row = np.repeat(np.arange(len(texts)), [g.sum() for g in good])
    col = np.concatenate([c[g] for (c, _), g in zip(cells, good, strict=True)])
    value = np.concatenate([n[g] for (_, n), g in zip(cells, good, strict=True)]) * ratio[col]
    del cells, good
    used, col = np.unique(col, return_inverse=True)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both classes weigh the same
    w = np.zeros(len(used) + 1)  # the last one is the intercept
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        z = np.bincount(row, value * w[col], minlength=len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        gradient = np.r_[np.bincount(col, value * error[row], minlength=len(used)) + PENALTY * w[:-1], error.sum()]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= 0.02 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = w[:-1] * ratio[used]
    return Model(weights, float(w[-1]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    known = labels.where("toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = training_rows(docs, labels, sample).orderBy("doc_id", "text").toPandas()  # bounded by sample
    model = fit(rows["text"].tolist(), rows["toxic"].astype(int).tolist())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def make() -> Callable[[list[bytes]], dict]:
        model = shared.value
        return lambda texts: {"score": pa.array([model.score(t.decode()) for t in texts], pa.float64())}

    found = map_texts(docs, make, "score double", ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
