"""Published batches under a commit log: one pointer that only moves forward, by compare and swap.

Data of a batch is written to a folder of its own first; it counts once a record of the log names it. A record is a
file that must not exist yet, put in place by a rename that never overwrites: of two writers one wins, the other
looks at the new head and decides again. Earlier versions of a date stay as revisions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

TRIES = 20


class BatchLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *x)))
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("log").getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def records(self) -> list[dict]:
        """All records in order; a batch is one record, whatever its rows."""
        log = self._path("log")
        if not self._fs.exists(log):
            return []
        rows = self.spark.read.schema("version long, batch_date string, content_hash string, crawler_ts long, status string, folder string").json(f"{self.path}/log/*.json").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["version"])

    def commit(self, expected: int, record: dict) -> bool:
        """Add ``record`` as version ``expected`` + 1; False if another writer has been there first."""
        self._fs.mkdirs(self._path("log"))
        draft, place = self._path(f"draft-{uuid.uuid4().hex}"), self._path("log", f"{expected + 1:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(record | {"version": expected + 1}).encode()))
        out.close()
        try:
            self._context.rename(draft, place, self._no_overwrite)
            return True
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False

    @staticmethod
    def verdict(records: list[dict], batch_date: str, content_hash: str, crawler_ts: int) -> str:
        """What publishing such a batch would be: PUBLISHED, REVISED, NO_CHANGES or STALE_SOURCE."""
        good = [r for r in records if r["status"] != "FAIL"]
        same = [r for r in good if r["batch_date"] == batch_date]
        if same and same[-1]["content_hash"] == content_hash:
            return "NO_CHANGES"
        if good and (batch_date, crawler_ts) < max((r["batch_date"], r["crawler_ts"]) for r in good):
            return "STALE_SOURCE"
        return "REVISED" if same else "PUBLISHED"

    def publish(self, batch: DataFrame, batch_date: str, content_hash: str, crawler_ts: int, status: str = "PASS") -> str:
        """Publish under compare and swap; FAIL goes to the quarantine and never becomes current. Returns what was done."""
        folder = None
        for _ in range(TRIES):
            records = self.records()
            said = "QUARANTINED" if status == "FAIL" else self.verdict(records, batch_date, content_hash, crawler_ts)
            if said in ("NO_CHANGES", "STALE_SOURCE"):
                return said
            if folder is None:
                folder = f"{'quarantine' if status == 'FAIL' else 'batches'}/{uuid.uuid4().hex}"
                batch.write.parquet(f"{self.path}/{folder}")
            head = records[-1]["version"] if records else 0
            if self.commit(head, {"batch_date": batch_date, "content_hash": content_hash, "crawler_ts": crawler_ts, "status": status, "folder": folder}):
                return said
        raise RuntimeError(f"{TRIES} other writers were faster")

    def latest(self) -> dict | None:
        good = [r for r in self.records() if r["status"] != "FAIL"]
        return max(good, key=lambda r: (r["batch_date"], r["crawler_ts"], r["version"])) if good else None

    def current(self, batch_date: str | None = None) -> DataFrame | None:
        """The rows of the latest batch, or of the latest version of a date."""
        good = [r for r in self.records() if r["status"] != "FAIL" and batch_date in (None, r["batch_date"])]
        if not good:
            return None
        newest = max(good, key=lambda r: (r["batch_date"], r["version"]))
        return self.spark.read.parquet(f"{self.path}/{newest['folder']}")

    def revisions(self, batch_date: str) -> list[str]:
        """Content hashes of the earlier versions of a date, oldest first."""
        return [r["content_hash"] for r in self.records() if r["batch_date"] == batch_date and r["status"] != "FAIL"][:-1]
