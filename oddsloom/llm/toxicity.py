"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear classifier over hashed letter words and word beginnings is trained from confirmed toxic texts
and a bounded sample of unlabelled ones. The risk of the unlabelled texts as negatives is corrected by
the class prior and held at zero or above, so the model cannot win by overfitting the positives. The
bias is then set by cross-fitting, on positives that a fit has not seen: 0.5 is the score with the best
F of estimated precision and recall, recall counting BETA times, with the precision estimated from the
prior and the share of unlabelled texts above.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import WORD_BITS, Adam, bounded_sample, held_out, sigmoid, word_slots
from .textops import Texts, give_back, keep_rows, pieces

SIZE = 1 << WORD_BITS
COLUMNS = 512  # of the dense training matrix, which holds a bounded number of rows
LEAST_POSITIVES = 3  # in which a feature must occur
FOLDS, LEAST_TO_SET = 4, 80  # of the positives, for the bias
BETA = 1.5  # a toxic text that stays costs more than a clean one that goes


def _slots(rows: DataFrame) -> list[np.ndarray]:
    """The feature slots of each row's text, in the order of the texts' hashes; ``rows`` is a bounded sample."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(0)):
                owner, slot = word_slots(t)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(t))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(t.first, len(t)), pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int32)))], ["mark", "slots"])

    table = rows.select("text", F.xxhash64("text").alias("mark")).mapInArrow(run, "mark long, slots array<int>").toArrow().sort_by("mark")
    return [np.asarray(x.values) for x in table.column("slots")]


def _matrix(rows: list[np.ndarray], column: np.ndarray) -> np.ndarray:
    """Presence of the chosen slots, dense, and a last column of ones: rows by features."""
    x = np.zeros((len(rows), int(column.max(initial=-1)) + 2), np.float32)
    x[:, -1] = 1
    for k, slots in enumerate(rows):
        own = column[slots]
        x[k, own[own >= 0]] = 1
    return x


def slot_counts(rows: list[np.ndarray]) -> np.ndarray:
    """How often each slot occurs, added up row by row."""
    n = np.zeros(SIZE, np.int32)
    for slots in rows:
        np.add.at(n, slots, 1)
    return n


def informative(positive: list[np.ndarray], n_u: np.ndarray, unlabelled: int, chance: float) -> np.ndarray:
    """A column for each slot that is more frequent in positives than ``chance`` allows, by its count in so many unlabelled rows; -1 for the others."""
    n_p = slot_counts(positive)
    seen = np.flatnonzero(n_p >= LEAST_POSITIVES)
    expected = (n_u[seen] + 0.5) / (unlabelled + 1) * len(positive)
    over = n_p[seen] > 1.5 * expected
    seen, expected = seen[over], expected[over]
    tail = np.array([n * np.log(e) - e - lgamma(n + 1) for n, e in zip(n_p[seen], expected, strict=True)])
    chosen = seen[np.argsort(tail, kind="stable")][: min(COLUMNS, int((tail < np.log(chance)).sum()))]
    column = np.full(SIZE, -1, np.int16)
    column[chosen] = np.arange(len(chosen))
    return column


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 3e-4) -> np.ndarray:
    """Weights that minimise the non-negative PU risk with the logistic loss; the last one is the bias."""
    xp, xu = positive, unlabelled
    w = np.zeros(xp.shape[1])
    w[-1] = -2.0
    best = Adam(len(w), rate)
    for _ in range(steps):
        small = w.astype(np.float32)
        fp, fu = (xp @ small).astype(float), (xu @ small).astype(float)
        sp, su = sigmoid(fp).astype(np.float32), sigmoid(fu).astype(np.float32)
        g_pos = -((1 - sp) @ xp) / len(xp)  # gradient of the loss of positives as positives
        g_neg = (su @ xu) / len(xu) - prior * (sp @ xp) / len(xp)
        risk_neg = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g = prior * g_pos + g_neg if risk_neg >= 0 else -g_neg
        w = best.step(w, g + ridge * np.append(w[:-1], 0))
    return w


def best_limit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin with the best F, whose precision is estimated as prior * recall / share of unlabelled above."""
    at = np.unique(positive)
    recall = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    precision = prior * recall / np.maximum(above, prior * recall)
    best = int(((1 + BETA**2) * precision * recall / (BETA**2 * precision + recall)).argmax())
    under = unlabelled[unlabelled < at[best]].max(initial=at[best] - 1.0)
    return float((at[best] + max(under, at[best] - 1.0)) / 2)  # between it and the next text below


def train(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, chance: float) -> dict:
    """The model: a column per slot and the weights. At most about ``positives`` and ``unlabelled`` texts are read."""
    own = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text")
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = bounded_sample(known.filter("toxic = 1").select("doc_id"), ["doc_id"], positives)
    p = _slots(bounded_sample(own.join(toxic, "doc_id", "left_semi"), ["text", "doc_id"], 2 * positives))  # ids may have many rows
    u = _slots(bounded_sample(own, ["doc_id", "text"], unlabelled))
    if not p or not u:
        return {"column": np.full(SIZE, -1, np.int16), "w": np.array([-20.0])}
    prior, n_u = min(max(share, 0.01), 0.9), slot_counts(u)

    def fit(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = informative(some, n_u, len(u), chance)
        x_u = _matrix(u, column)
        w = nnpu(_matrix(some, column), x_u, prior)
        return column, w, x_u @ w

    column, w, _ = fit(p)
    if len(p) >= LEAST_TO_SET:  # the rows are in the order of their hashes, so the folds are random
        unseen, others = [], []
        for k in range(FOLDS):
            fold, w_k, margins = fit([x for i, x in enumerate(p) if i % FOLDS != k])
            unseen.append(_matrix(p[k::FOLDS], fold) @ w_k)
            others.append(margins)
        w[-1] -= best_limit(np.concatenate(unseen), np.concatenate(others), prior)
    return {"column": column, "w": w}


def scores(t: Texts, model: dict) -> np.ndarray:
    owner, slot = word_slots(t)
    col = model["column"][slot]
    keep = col >= 0
    return sigmoid(np.bincount(owner[keep], weights=model["w"][col[keep]], minlength=len(t)) + model["w"][-1])


class Toxicity:
    """A trained model, for scoring any texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 6000, chance: float = 1e-3):
        self.shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, positives, unlabelled, chance))
        give_back()  # the driver lives on as well, beside its JVM

    def below(self, docs: DataFrame, limit: float) -> DataFrame:
        """The rows of ``docs`` that score less than ``limit``, with all columns; null texts score as empty ones."""
        shared = self.shared
        return keep_rows(docs, lambda t: scores(t, shared.value) < limit)


def score_toxicity(docs: DataFrame, labels: DataFrame, **bounds: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Learns from rows whose crc32(doc_id) mod 5 is not 0: the texts of at most ``positives`` rows with
    toxic 1, and ``unlabelled`` texts of any kind. Several labels of a doc_id: the highest counts. Null
    labels and ids are left out; null and empty texts get the score of no words. Without a positive all
    scores are near 0; with fewer than 80 positives the bias stays as fitted. Repeated rows give repeated
    rows; an empty table gives none; other columns are not read.
    """
    shared = Toxicity(docs, labels, **bounds).shared

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(2)):
                own, score = batch.slice(t.first, len(t)), scores(t, shared.value)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
