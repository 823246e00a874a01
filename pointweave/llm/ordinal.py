"""Ordinal quality classifier: cumulative-link regression on hashed text features.

Grades are ordered; one weight vector is shared by all of them, and ordered thresholds cut its score:
``P(grade <= k) = sigmoid(threshold_k - w.x)``.  Features are hashed words (present or not) and hashed bins of shape
measures (symbols, capitals, repetition, length).  Fitting reads about ``sample_rows`` labelled documents,
with FTRL-proximal steps whose L1 term keeps few weights; grading reads every document's whole text.

Defined results
    * null text: graded as the empty text.  Very long texts: read whole.
    * null grade: not used in fitting; without any graded row, all documents get the middle grade and a
      tail of one half, and are kept.
    * repeated rows: graded alike, one by one.  Empty input: no rows.
    * extra columns stay; columns named like the result are replaced.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that words and shape bins are hashed into.
BUCKETS = 1 << 18
#: Labelled documents that are used for fitting, about (drawn by hash of the id).
SAMPLE_ROWS = 20_000
#: Least probability of the upper grades for a document to be selected.
LEAST_TAIL = 0.5

MARKS = ".,;:!?\"'()[]{}<>#*$%&|~^_=+/\\-"


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


@functools.lru_cache(maxsize=1 << 16)
def _of_word(word: str) -> int:
    return _bucket("w:" + (word.strip(MARKS).lower() or word))


def features(text: str | None) -> np.ndarray:
    """The sorted buckets of a text's features."""
    words = (text or "").split()
    n = max(1, len(words))
    kinds = set(words)
    chars = sum(map(len, words)) or 1
    symbols = sum(text.count(c) for c in "#*$%&|<>") if text else 0
    shape = {
        "symbols": min(12, math.ceil(8 * symbols / n)),
        "upper": min(8, math.ceil(8 * sum(map(str.isupper, words)) / n)),
        "shout": min(8, math.ceil(8 * (text or "").count("!") / n)),
        "pipes": min(8, math.ceil(8 * (text or "").count("|") / n)),
        "kinds": int(10 * len(kinds) / n) if n >= 20 else -1,
        "length": min(20, int(chars / n)),
        "size": n.bit_length(),
    }
    found = set(map(_of_word, kinds))
    found.update(_bucket(f"s:{k}={v}") for k, v in shape.items())
    return np.array(sorted(found), np.int32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by bucket (most are zero) and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float) -> np.ndarray:
        """``P(grade >= k)`` for k = 1, 2, ..."""
        return _sigmoid(score - self.thresholds)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 20, batch: int = 64, rate: float = 1.0, l1: float = 15.0, l2: float = 0.1, seed: int = 7) -> OrdinalModel:
    """Fits weights and thresholds by FTRL-proximal on the cumulative-link likelihood."""
    cuts = n_grades - 1
    if not rows:
        return OrdinalModel(np.zeros(BUCKETS), np.zeros(cuts))  # every tail is one half
    share = np.array([(grades <= k).mean() for k in range(cuts)])
    theta = np.log((share + 1e-3) / (1 - share + 1e-3))
    z, n, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    counts = np.bincount(grades, minlength=n_grades).astype(float)
    importance = np.sqrt(counts.max() / np.maximum(counts, 1.0))  # rare grades count more
    theta_n = np.zeros(cuts)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.array([len(rows[i]) for i in own])
            flat = np.concatenate([rows[i] for i in own])
            score = np.add.reduceat(w[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            y = grades[own]
            upper = np.where(y < cuts, _sigmoid(np.append(theta, 0.0)[y] - score), 1.0)
            lower = np.where(y > 0, _sigmoid(theta[y - 1] - score), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            weight = importance[y]
            g_score = weight * (du - dl) / p  # d(-log p)/d(score)
            g_theta = np.zeros(cuts)
            np.add.at(g_theta, y[y < cuts], -(weight * du / p)[y < cuts])
            np.add.at(g_theta, y[y > 0] - 1, (weight * dl / p)[y > 0])
            touched, where = np.unique(flat, return_inverse=True)
            g = np.bincount(where, weights=np.repeat(g_score, sizes))
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / rate
            z[touched] += g - sigma * w[touched]
            n[touched] += g * g
            zt = z[touched]
            w[touched] = np.where(np.abs(zt) <= l1, 0.0, -(zt - np.sign(zt) * l1) / ((1.0 + np.sqrt(n[touched])) / rate + l2))
            theta_n += g_theta * g_theta
            theta = np.maximum.accumulate(theta - 0.1 * g_theta / (1.0 + np.sqrt(theta_n)))
    return OrdinalModel(w, theta)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null if unknown."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def train(docs: DataFrame, labels: DataFrame, n_grades: int = 3, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fits on ``docs(doc_id, text)`` and ``labels(doc_id, grade)``."""
    labels = labels.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id"), F.col("grade").cast("int"))
    known = labels.count()
    parts = 1 << 30
    if known > sample_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(parts * sample_rows / known))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "grade", "buckets"])

    # at most about sample_rows rows of two numbers: safe to send to every executor
    joined = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "grade", "text")
    got = joined.mapInArrow(extract, "doc_id long, grade int, buckets array<int>").toArrow().sort_by("doc_id")
    rows = [np.asarray(x, np.int32) for x in got.column("buckets").to_pylist()]
    return fit(rows, np.asarray(got.column("grade"), np.int64), n_grades)


def grade(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """Adds expected_grade, tail_probability (of the highest grade) and selected to every document."""
    columns = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "selected")]
    docs = docs.select(*columns)
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), model.weights[used], model.thresholds))  # at most BUCKETS weights
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values, thresholds = shared.value
        own = OrdinalModel(np.zeros(BUCKETS), thresholds)
        own.weights[index] = values
        for b in batches:
            tails = np.array([own.tails(float(own.weights[features(t.as_py())].sum())) for t in b.column(at)]).reshape(b.num_rows, len(thresholds))
            yield pa.record_batch([*b.columns, pa.array(tails.sum(axis=1).round(6)), pa.array(tails[:, -1].round(6)), pa.array(tails[:, -1] >= least_tail)], names=[*columns, "expected_grade", "tail_probability", "selected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, expected_grade double, tail_probability double, selected boolean")
