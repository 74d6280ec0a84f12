"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter trigrams. Document frequencies are counted
over all training rows; each language's clusters are found by spherical k-means on a bounded sample
of its rows, in a task of its own. A text takes the language of the centroid with the highest cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import LETTERS_ONLY, TRIGRAM_BITS, bounded_sample, held_out, no_letters, sparse_rows, trigrams
from .store import Scratch
from .textops import Texts, pieces

SIZE = 1 << TRIGRAM_BITS


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.square(x).sum(axis=1, keepdims=True)), 1e-12)


def vectors(t: Texts, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(trigrams(t, LETTERS_ONLY)) * idf)


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all ``rows`` (text); a count per slot reaches the driver."""

    def run(batches):
        total, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for t in pieces(batch.column(0)):
                total += (trigrams(t, LETTERS_ONLY) > 0).sum(axis=0)
                n += len(t)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(np.append(total, n))], ["slot", "n"])

    counts = rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SIZE + 1)
    n[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    return np.log((1 + n[-1]) / (1 + n[:-1])).astype(np.float32) + 0.1


def _cluster(x: np.ndarray, count: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts; the centroids and each one's share of far-out cosines."""
    centre = _unit(x.mean(axis=0, keepdims=True))
    picks = [int((x @ centre[0]).argmax())]
    for _ in range(min(count, len(x)) - 1):
        picks.append(int((x @ x[picks].T).max(axis=1).argmin()))
    c = x[picks]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c = _unit(c)
    cos = x @ c.T
    own, best = cos.argmax(axis=1), cos.max(axis=1)
    limits = np.array([np.quantile(best[own == k], 0.01) if (own == k).any() else 1.0 for k in range(len(c))])
    return c, limits


def fit(train: DataFrame, clusters: int, sample: int, idf: np.ndarray) -> dict:
    """Centroids of every language of ``train`` (doc_id, text, lang): ``clusters`` rows per language."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def rows(batches):
        for batch in batches:
            for t in pieces(batch.column(1)):
                slots, values = sparse_rows(vectors(t, shared.value))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), slots, values], ["lang", "slots", "vals"])

    def clusters_of(key, pdf):
        x = np.zeros((len(pdf), SIZE), np.float32)
        for k, (s, v) in enumerate(zip(pdf["slots"], pdf["vals"], strict=True)):
            x[k, s] = v
        x = x[np.abs(x).sum(axis=1) > 0]
        if not len(x):
            return pd.DataFrame()
        c, limits = _cluster(x, clusters)
        return pd.DataFrame({"lang": key[0], "centroid": list(c.astype(np.float32)), "least": limits})

    sampled = bounded_sample(train, ["doc_id", "text"], sample, by="lang").select("lang", "text").mapInArrow(rows, "lang string, slots array<int>, vals array<float>")
    found = sampled.groupBy("lang").applyInPandas(clusters_of, "lang string, centroid array<float>, least double").collect()
    found.sort(key=lambda r: (r["lang"], r["least"], r["centroid"]))
    return {"lang": [r["lang"] for r in found], "c": np.array([r["centroid"] for r in found], np.float32).reshape(-1, SIZE), "least": np.array([r["least"] for r in found])}


def identify_languages(docs: DataFrame, clusters: int = 4, sample: int = 800) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs``.

    Learns from rows with a non-null lang and doc_id whose crc32(doc_id) mod 4 is not 2; ``sample`` rows
    of each language at most (by hash) for its centroids, all of them for the document frequencies.
    score: the cosine with the nearest centroid. rejected: it lies further out than 99 of 100 rows that
    the centroid was made of. Null texts and texts without letters: ``und`` with score 0 and rejected.
    Without any training row all are ``und``. Ties go to the first language in order. Repeated rows
    give repeated rows; an empty table gives none; other columns are not read.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    train = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~out).select("doc_id", "text", "lang")
    idf = document_frequencies(train)
    model = docs.sparkSession.sparkContext.broadcast(fit(train, clusters, sample, idf) | {"idf": idf})

    def run(batches):
        m = model.value
        names = np.array([*m["lang"], "und"], object)
        for batch in batches:
            for t in pieces(batch.column(2)):
                n = len(t)
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if len(m["lang"]):
                    cos = vectors(t, m["idf"]) @ m["c"].T
                    score = np.clip(cos.max(axis=1).astype(float), 0, 1)
                    best = np.where(no_letters(t), len(names) - 1, cos.argmax(axis=1))
                score = np.where(best == len(names) - 1, 0.0, score)
                rejected = score < np.append(m["least"], 1.0)[best]
                own = batch.slice(t.first, n)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
