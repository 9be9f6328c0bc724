"""Incremental work as Structured Streaming: all jobs end when what there is has been read (availableNow)."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from quillmill.sources.store import same


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1, bytes_per_batch: int | None = None) -> DataFrame:
    """A micro-batch takes files_per_batch files, or about bytes_per_batch bytes of them; without either, all that are there and new."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if bytes_per_batch:
        return stream.option("maxBytesPerTrigger", bytes_per_batch).parquet(path)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, work, mode: str = "append") -> None:
    """work(df, batch id) for each micro-batch, until the input is read."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(work).start().awaitTermination()


def run_to_table(stream: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Appends to a parquet table; each micro-batch is there once, even if it ran twice."""
    stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def incremental_ingest(spark: SparkSession, staged: str, root: str, files_per_batch: int | None = 1, bytes_per_batch: int | None = None, **options) -> None:
    """ST1: the list of staged files, a folder of parquet files whose rows are files of any route as ingest_files() takes them
    (options are its own). What is stored leaves the folder; rows that failed, were held back or not attempted stay in it, in files
    of their own, and are tried again by the next run. Batches are sized by files or, if it is given, by bytes_per_batch. A batch id names what it wrote, so a rerun adds nothing.

    Files are archived below root when the run has ended, since a batch that is repeated reads them again; what stays is
    moved into the folder before, name by name, so a run that was cut short is brought to its end by the next one."""
    from quillmill.plans.ingest import hashed, ingest_files

    tidy_staged(spark, staged, root)
    if not any_parquet(spark, staged):
        return
    stream = read_stream(spark, staged, files_per_batch, bytes_per_batch).withColumn("_taken", F.col("_metadata.file_path"))

    def work(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            files = df.drop("_taken")
            report = ingest_files(files, root, batch, **options).filter("status <> 'stored'").select("book_id", "sha256")
            known = hashed(files).alias("l").join(report.distinct().alias("r").hint("merge"), same("l", "r", ["book_id", "sha256"]), "left_semi")
            known.select(files.columns).write.mode("overwrite").parquet(f"{root}/left/batch={batch}")
            df.select("_taken").distinct().write.mode("overwrite").parquet(f"{root}/taken/batch={batch}")
        finally:
            df.unpersist()

    run_batches(stream, f"{root}/checkpoint", work)
    tidy_staged(spark, staged, root)


def any_parquet(spark: SparkSession, folder: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    return len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []) > 0


def tidy_staged(spark: SparkSession, staged: str, root: str) -> None:
    """Moves what the batches of a run have left into the folder, and archives the files that they took. All are moved by name on
    the driver, as many as there are files in the folder."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = path(root).getFileSystem(conf)
    fs.mkdirs(path(f"{root}/archive"))
    for f in fs.globStatus(path(f"{root}/left/*/*.parquet")) or []:
        batch, name = f.getPath().getParent().getName(), f.getPath().getName()
        fs.rename(f.getPath(), path(f"{staged}/left-{batch.removeprefix('batch=')}-{name}"))
    if fs.exists(path(f"{root}/taken")):
        for (name,) in spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/taken").distinct().toLocalIterator():
            p = path(spark._jvm.java.net.URI(name))
            if fs.exists(p):
                fs.rename(p, path(f"{root}/archive/{p.getName()}"))
        fs.delete(path(f"{root}/taken"), True)
    fs.delete(path(f"{root}/left"), True)


def stream_dedup(stream: DataFrame, keys: list[str]) -> DataFrame:
    """ST2: each key once, over all time; state grows with the keys."""
    return stream.dropDuplicates(keys)


def stream_dedup_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """ST2 with bounded state: a key counts as new again once its time has passed."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class ProgressTable(StreamingQueryListener):
    """ST3: appends the observed metrics of each batch of the streams that observe `name` to a table of JSON files."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.running: set[str] = set()
        self.ended = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self.ended:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is not None and p.numInputRows:
            values = {"batch": p.batchId, "run": str(p.runId), "at": p.timestamp, **row.asDict()}
            self.spark.createDataFrame([(json.dumps(values, default=str),)], "value string").write.mode("overwrite").text(f"{self.path}/batch={p.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.ended:
            self.running.discard(str(event.runId))
            self.ended.notify_all()

    def wait(self, seconds: float = 60) -> None:
        """Events come after the query: until those of all its batches are written."""
        with self.ended:
            if not self.ended.wait_for(lambda: not self.running, seconds):
                raise TimeoutError("the listener hasn't heard of the end of the stream")


def progress_counts(stream: DataFrame, name: str, done: Column, *more: Column) -> DataFrame:
    """ST3: rows and finished rows of each micro-batch, and more metrics, observed of the running query; see run_with_progress()."""
    return stream.observe(name, F.count("*").alias("rows"), F.count_if(done).alias("done"), *more)


def run_with_progress(stream: DataFrame, name: str, checkpoint: str, path: str, progress: str) -> DataFrame:
    """ST3: runs an observed stream into a table, and gives the table of progress: batch, run, at and the metrics."""
    spark = stream.sparkSession
    heard = ProgressTable(spark, name, progress)
    spark.streams.addListener(heard)
    try:
        run_to_table(stream, checkpoint, path)
        heard.wait()
    finally:
        spark.streams.removeListener(heard)
    return spark.read.option("recursiveFileLookup", "true").json(progress)


def conversation_tail(turns: DataFrame) -> DataFrame:
    """ST4: the header of each conversation, to be written in update mode. State stays for ever; see conversation_tail_expiring()."""
    first = F.min_by(F.substring("text", 1, 20), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.coalesce(first, F.lit("New conversation")).alias("title"), F.max("turn").alias("last_turn"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that processors of keys need, for the streams that are run inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Tail(StatefulProcessor):
    """The first user turn's title and the last turn of a conversation; one that is silent for idle_ms is forgotten."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("tail", "title string, titled long, last long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        title, titled, last, seen = self.state.get() if self.state.exists() else (None, None, None, None)
        was = seen
        for frame in rows:
            ms = frame["ts"].astype("datetime64[ns]").to_numpy().astype("int64") // 1_000_000
            for turn, text, at in sorted(zip(frame["turn"].tolist(), frame["text"].tolist(), ms.tolist(), strict=True), key=lambda r: (r[2], r[0])):
                if seen is not None and at - seen >= self.idle_ms:
                    title = titled = last = None  # its timer is due, but comes after the rows of a batch
                seen = at if seen is None else max(seen, at)
                last = turn if last is None else max(last, turn)
                if text is not None and (titled is None or turn < titled):
                    title, titled = text, turn
        if was is not None:
            self.handle.deleteTimer(was + self.idle_ms)
        self.handle.registerTimer(seen + self.idle_ms)
        self.state.update((title, titled, last, seen))
        yield pd.DataFrame({"conv_id": [key[0]], "title": ["New conversation" if title is None else title], "last_turn": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame({"conv_id": pd.Series([], dtype="int64"), "title": pd.Series([], dtype=object), "last_turn": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def conversation_tail_expiring(turns: DataFrame, idle_ms: int, delay: str = "0 seconds") -> DataFrame:
    """ST4 with bounded state: turns (conv_id, turn, role, text, ts, none of the ids, turns and times null). A conversation that is
    silent for idle_ms in event time is forgotten, and a turn that comes later begins a header of its own; rows later than delay
    behind the newest are left out, as Spark does with them. Portions of a batch are read one after the other. Run it inside
    keyed_state()."""
    rows = turns.select("conv_id", "turn", F.when(F.col("role") == "user", F.substring("text", 1, 20)).alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", delay).groupBy("conv_id").transformWithStateInPandas(Tail(idle_ms), "conv_id long, title string, last_turn long", "Update", "EventTime")


class Breaker(StatefulProcessor):
    """Counts failures in a row of each key; from the n-th on the key is open. Rows of a batch go by time. With idle_ms, a timer
    in event time forgets a key that has had no row for so long."""

    def __init__(self, n: int, idle_ms: int | None = None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", "length int, open boolean, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        length, open_, last = self.state.get() if self.state.exists() else (0, False, None)
        # Portions are cut to three small columns; a batch has as many rows as its trigger lets in.
        parts = [(f["ts"].astype("datetime64[ns]").to_numpy().astype("int64") // 1_000_000, f["event_id"].to_numpy(), f["failed"].to_numpy(bool)) for f in rows]
        ms, events, failed = (np.concatenate(x) for x in zip(*parts, strict=True))
        degraded = np.zeros(len(ms), bool)
        order, newest = np.lexsort((events, ms)), last
        for k, at, bad in zip(order.tolist(), ms[order].tolist(), failed[order].tolist(), strict=True):
            if self.idle_ms is not None and newest is not None and at - newest >= self.idle_ms:
                length, open_ = 0, False  # its timer is due, but comes after the rows of a batch
            degraded[k] = open_
            length = length + 1 if bad else 0
            open_ = bool(open_ or length >= self.n)
            newest = at if newest is None else max(newest, at)
        if self.idle_ms is not None:
            if last is not None:
                self.handle.deleteTimer(last + self.idle_ms)
            self.handle.registerTimer(newest + self.idle_ms)
        self.state.update((length, open_, newest))
        yield pd.DataFrame({"user_id": key[0], "event_id": events, "degraded": degraded})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "degraded": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def failure_breaker(stream: DataFrame, n: int, idle_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """ST5: stream (user_id, event_id, ts, failed): adds degraded to each row, as degrade_after_failures does for a table, if no
    micro-batch has rows older than those of an earlier one. With idle_ms, a key without rows for so long (in event time) is forgotten, so it starts closed again, and rows that come later
    than delay behind the newest are left out, as Spark does with them; without, state stays for ever. Run it inside keyed_state()."""
    rows = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "failed")
    rows = rows if idle_ms is None else rows.withWatermark("ts", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(Breaker(n, idle_ms), "user_id long, event_id long, degraded boolean", "Append", "None" if idle_ms is None else "EventTime")
