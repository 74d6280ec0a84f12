"""The rows of an index that share their key with a row of another id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import partitions
from .textops import give_back


def colliding(keys: DataFrame) -> DataFrame:
    """The distinct (key, id) rows whose key occurs with two ids or more.

    One shuffle by key; each task streams over its sorted rows and compares neighbours, so a frequent
    key needs no memory of its own.
    """
    n = max(2, partitions(keys.sparkSession))
    dealt = keys.repartition(n, "key").sortWithinPartitions("key", "id")

    def run(batches):
        last_key = last_id = None  # the last row seen; it is held back until its successor is known
        last_out = False
        for batch in batches:
            key, id_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])
            new[0] = key[0] != last_key or id_[0] != last_id
            key, id_ = key[new], id_[new]
            if not len(key):
                continue
            if last_key is not None:
                key, id_ = np.append(last_key, key), np.append(last_id, id_)
            same = key[1:] == key[:-1]
            hit = np.zeros(len(key), bool)
            hit[1:] |= same
            hit[:-1] |= same
            if last_key is not None:
                hit[0] |= last_out
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][hit[:-1]]), pa.array(id_[:-1][hit[:-1]])], ["key", "id"])
            last_key, last_id, last_out = key[-1], id_[-1], bool(hit[-1])
        if last_key is not None and last_out:
            yield pa.RecordBatch.from_arrays([pa.array([last_key]), pa.array([last_id])], ["key", "id"])
        give_back()

    return dealt.select("key", "id").mapInArrow(run, "key long, id long")
