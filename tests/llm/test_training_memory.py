"""What training leaves in the driver: slots are counted row by row, and freed memory is handed back."""

from __future__ import annotations

import tracemalloc

import numpy as np

from oddsloom.llm import toxicity


def test_counts_of_slots_need_no_copy_of_all_rows():
    r = np.random.default_rng(2)
    rows = [r.integers(0, toxicity.SIZE, 20_000).astype(np.int32) for _ in range(400)]
    tracemalloc.start()
    n = toxicity.slot_counts(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # the rows have 32 MB
    assert (n == np.bincount(np.concatenate(rows), minlength=toxicity.SIZE)).all()


def test_the_driver_hands_memory_back_after_training(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1), raising=False)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    toxicity.Toxicity(docs, spark.createDataFrame([(k, 0, k % 2) for k in range(20)], "doc_id long, quality int, toxic int"))
    assert calls
