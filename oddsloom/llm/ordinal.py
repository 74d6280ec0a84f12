"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector is shared by all grades and the
thresholds stay ordered. The expected grade and the probability of the upper grades rank documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import TRIGRAM_BITS, Adam, bounded_sample, held_out, sigmoid, sparse_rows, trigrams
from .textops import Texts, pieces

LENGTHS = 24
SIZE = (1 << TRIGRAM_BITS) + LENGTHS


def vectors(t: Texts) -> np.ndarray:
    """Normalised log counts of hashed byte trigrams, a distinct-share and a length bucket (half powers of two)."""
    raw = trigrams(t)
    x = np.log1p(raw)
    x /= np.maximum(np.sqrt(np.square(x).sum(axis=1, keepdims=True)), 1e-12)
    size = np.diff(t.offsets)
    bucket = np.minimum(np.log2(size + 1.0).astype(np.int64), LENGTHS - 2)
    more = np.zeros((len(t), LENGTHS), np.float32)
    more[np.arange(len(t)), bucket] = 0.5
    total = raw.sum(axis=1)
    more[:, -1] = np.log1p(total) - np.log1p((raw > 0).sum(axis=1))
    return np.hstack((x, more * 0.5))


def fit(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = 250, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative logit model, with grades weighted alike."""
    count = np.bincount(grade, minlength=grades)
    weight = (len(grade) / np.maximum(count, 1) / (count > 0).sum())[grade] ** 0.5
    weight /= weight.sum()
    size = x.shape[1]
    z = np.concatenate((np.zeros(size), [-1.0], np.full(grades - 2, 0.5)))
    adam = Adam(len(z), rate)
    for _ in range(steps):
        w, first, gaps = z[:size], z[size], z[size + 1 :]
        steps_up = np.exp(gaps)
        theta = np.concatenate(([first], first + np.cumsum(steps_up)))
        f = (x @ w.astype(np.float32)).astype(float)
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = sigmoid(edge[grade + 1] - f), sigmoid(edge[grade] - f)
        hi, lo = np.where(grade == grades - 1, 1.0, hi), np.where(grade == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_w = (weight * (d_hi - d_lo)).astype(np.float32) @ x + ridge * w
        g_theta = np.array([-(weight * d_hi)[grade == k].sum() + (weight * d_lo)[grade == k + 1].sum() for k in range(grades - 1)])
        g_gaps = np.array([g_theta[k + 1 :].sum() for k in range(grades - 2)]) * steps_up
        z = adam.step(z, np.concatenate((g_w, [g_theta.sum()], g_gaps)))
    return z[:size], np.concatenate(([z[size]], z[size] + np.cumsum(np.exp(z[size + 1 :]))))


def train(rated: DataFrame, grades: int, sample: int) -> dict:
    """The model from ``rated`` (doc_id, text, grade); at most about ``sample`` rows (by hash) are gathered."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(0)):
                slots, values = sparse_rows(vectors(t))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(t.first, len(t)), slots, values], ["grade", "slots", "vals"])

    rows = bounded_sample(rated, ["doc_id", "text"], sample).select("text", F.col("grade").cast("int")).mapInArrow(run, "grade int, slots array<int>, vals array<float>").toArrow()
    if not rows.num_rows:
        return {"w": np.zeros(SIZE), "theta": np.linspace(-1, 1, grades - 1)}
    x = np.zeros((rows.num_rows, SIZE), np.float32)
    for k, (s, v) in enumerate(zip(rows.column("slots"), rows.column("vals"), strict=True)):
        x[k, np.asarray(s.values)] = np.asarray(v.values)
    w, theta = fit(x, rows.column("grade").to_numpy().astype(np.int64), grades)
    return {"w": w, "theta": theta}


def grade_of(labels: DataFrame) -> Column:
    """Ratings of ``labels``: 0 poor, 1 readable but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def grade_documents(docs: DataFrame, labels: DataFrame, sample: int = 2000, grades: int = 3, tail: int = 1) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (grade >= ``tail``) and selected (it is 0.5 or more).

    Learns from rated rows whose crc32(doc_id) mod 5 is not 0, at most about ``sample``. Several ratings
    of a doc_id: the lowest counts. Null ratings and ids are left out; null and empty texts are graded
    as texts without trigrams. Without ratings nothing is known: the grades come from fixed thresholds.
    Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    out = held_out(F.col("doc_id"), 5, 0)
    rated = labels.select("doc_id", grade_of(labels).alias("grade")).filter(F.col("grade").isNotNull() & ~out).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text").join(rated, "doc_id"), grades, sample))

    def run(batches):
        m = model.value
        for batch in batches:
            for t in pieces(batch.column(2)):
                f = vectors(t) @ m["w"].astype(np.float32)
                over = 1 - sigmoid(m["theta"][None, :] - f[:, None])  # P(grade > k)
                own = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(over.sum(axis=1)), pa.array(over[:, tail - 1])], ["doc_id", "held_out", "expected_grade", "tail_probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, tail_probability double")
    return rows.withColumn("selected", F.col("tail_probability") >= 0.5)
