"""Tables that cut lineage, in the folder which the whole cluster shares.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` and read again, so a
lost executor costs a re-read and never a recomputation of the plan behind the table.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one only where that is unset and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="oddsloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """A folder of its own for the tables of one operator call."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/oddsloom/{what}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def save(self, df: DataFrame, drop: DataFrame | None = None, batch_bytes: int = 16 << 20) -> DataFrame:
        """Write ``df``, read it back; ``drop``: an earlier table of this folder that is no longer needed.

        ``batch_bytes``: the size of Arrow batches during this write. Each task holds one on either side of its pipe.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        was = self.spark.conf.get(BATCH_BYTES)
        try:
            self.spark.conf.set(BATCH_BYTES, batch_bytes)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(BATCH_BYTES, was)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        if drop is not None:
            self.drop(drop)
        return back

    def free(self) -> None:
        """Have the driver collect its garbage, so that Spark deletes the shuffle files of what has been written."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
