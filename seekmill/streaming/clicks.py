"""Click counting as a stream, in memory or in a table that outlives the process."""

from __future__ import annotations

import time
import uuid
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekmill.operators.hot import click_counts, event_clicks
from seekmill.sources.shared import shared_folder


def stream_clicks(spark: SparkSession, path: str, schema) -> DataFrame:
    """A streaming frame of clicked doc_ids from event files that arrive at ``path``."""
    return event_clicks(spark.readStream.schema(schema).parquet(path))


def count_to_table(clicks: DataFrame, name: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the counts per document in the in-memory table ``name``; state, in the shared folder, is one row a clicked document."""
    state = f"{shared_folder(clicks.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = click_counts(clicks).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(clicks: DataFrame, time_col: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts per document and event-time window, closed once the watermark has passed."""
    return clicks.withWatermark(time_col, late).groupBy(F.window(time_col, window), "doc_id").agg(F.count("*").alias("click_count"))


class ClickTable:
    """Clicks in an append-only log, and their counts per document, which a stream keeps.

    A micro-batch writes its counts to a folder named by its id, so one that is repeated replaces itself. Every
    ``fold`` batches the folders become one with the sums up to there; the ones before the last such sum are then
    deleted, so readers that have listed them still find them. A batch that a sum has already is left out.
    Folders count once their write is committed. Clicks are on disk after ``batch`` of them or a ``flush``.
    """

    LOG = "doc_id long, ts timestamp"

    def __init__(self, spark: SparkSession, path: str, batch: int = 100, fold: int = 20, max_age: float = 0.0) -> None:
        self.spark, self.path, self.batch, self.fold, self.max_age = spark, path.rstrip("/"), batch, fold, max_age
        self._held: list[tuple] = []
        self._lock, self._turn, self._refreshed = Lock(), Lock(), float("-inf")
        for name in ("log", "deltas", "sums"):
            self._system(name)[0].mkdirs(self._system(name)[1])

    def _system(self, name: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _committed(self, name: str) -> list[int]:
        system, folder = self._system(name)
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(f.getPath().getName()) for f in system.listStatus(folder) if system.exists(done(f.getPath(), "_SUCCESS")))

    def _drop(self, name: str, batch_id: int) -> None:
        system, folder = self._system(f"{name}/{batch_id:020d}")
        system.delete(folder, True)

    def record(self, doc_id: int) -> None:
        with self._lock:
            self._held.append((doc_id, time.time()))
            full = len(self._held) >= self.batch
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._held = self._held, []
        if rows:
            made = self.spark.createDataFrame(rows, "doc_id long, at double").select("doc_id", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))
            made.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def add_batch(self, clicks: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: counts of the batch's clicked doc_ids."""
        sums = self._committed("sums")
        if sums and batch_id <= sums[-1]:
            return
        click_counts(clicks).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch_id:020d}")
        if (batch_id + 1) % self.fold == 0:
            self.totals().write.mode("overwrite").parquet(f"{self.path}/sums/{batch_id:020d}")
            for old in sums[:-1]:
                self._drop("sums", old)
            for old in self._committed("deltas"):
                if sums and old <= sums[-1]:
                    self._drop("deltas", old)

    def totals(self) -> DataFrame:
        """doc_id, click_count as far as the stream has come."""
        sums = self._committed("sums")[-1:]
        paths = [f"{self.path}/sums/{k:020d}" for k in sums] + [f"{self.path}/deltas/{k:020d}" for k in self._committed("deltas") if not sums or k > sums[0]]
        counts = "doc_id long, click_count long"
        read = self.spark.read.schema(counts).parquet(*paths) if paths else self.spark.createDataFrame([], counts)
        return read.groupBy("doc_id").agg(F.sum("click_count").alias("click_count"))

    def count(self, clicks: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Starts the stream that counts ``clicks`` (doc_id), a streaming frame."""
        writer = clicks.writeStream.foreachBatch(self.add_batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def refresh(self) -> None:
        """Counts what the log has, unless that was done ``max_age`` seconds ago or less."""
        with self._turn:
            if time.monotonic() - self._refreshed <= self.max_age:
                return
            self.flush()
            self.count(self.spark.readStream.schema(self.LOG).parquet(f"{self.path}/log").select("doc_id")).awaitTermination()
            self._refreshed = time.monotonic()
