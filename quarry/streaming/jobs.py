"""Structured Streaming forms of the batch operators: incremental ingest, windowed log statistics, latest status."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quarry.operators.tables import upsert_buckets, upsert_latest


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Upserts every micro-batch of transformed rows into a versioned Parquet table below ``path``.

    Version v of the table lies in path/v=<v>; batch v reads the newest version before its own and writes its own, so
    a repeated batch overwrites its own version only.  Versions older than that one are deleted once a batch is
    written.  A batch after the first that finds no earlier version at all fails: the table must not be lost silently.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        names = [x.getPath().getName() for x in store.listStatus(folder)] if store.exists(folder) else []
        done = [int(n[2:]) for n in names if n.startswith("v=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        before = max((v for v in done if v < number), default=None)
        if number and before is None:
            raise ValueError(f"no version before batch {number} below {path}")
        new = transform(batch).dropDuplicates(keys)
        (new if before is None else upsert_latest(spark.read.parquet(f"{path}/v={before}"), new, keys)).write.mode("overwrite").parquet(f"{path}/v={number}")
        for v in done:
            if before is not None and v < before:
                store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_buckets(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Upserts every micro-batch of transformed rows into a table dealt into buckets; a batch rewrites the buckets it meets.

    A batch that failed is repeated by Spark and then leaves what one run would have left.
    """

    def write(batch: DataFrame, number: int) -> None:
        upsert_buckets(transform(batch), keys, path, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def query_statistics(log: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, query, n, mean_ms) per window; rows later than the delay are dropped when streamed."""
    w = log.withWatermark("ts", delay) if log.isStreaming else log
    g = w.groupBy(F.window("ts", width).alias("w"), "query").agg(F.count("*").alias("n"), F.round(F.avg("execution_time_ms"), 6).alias("mean_ms"))
    return g.select(F.col("w.start").alias("start"), "query", "n", "mean_ms")


def sessions(log: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user, start, end, n): stretches of a user's log without a longer gap."""
    w = log.withWatermark("ts", delay) if log.isStreaming else log
    g = w.groupBy(F.session_window("ts", gap).alias("s"), F.col("result_count").alias("user")).agg(F.count("*").alias("n"))
    return g.select("user", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def latest_status(ledger: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(doc_id, store, status): newest status of every key; as a stream it runs in update mode, rows later than the delay are dropped."""
    w = ledger.withWatermark("ts", delay) if ledger.isStreaming else ledger
    return w.groupBy("doc_id", "store").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside keep their state in RocksDB, which arbitrary keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.streams  # starts what finds state stores; a batch job doesn't by itself  # noqa: B018
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class NewestStatus(StatefulProcessor):
    """Keeps the newest (ts, event_id, status) of a key; ``idle`` milliseconds of event time without a newer one end it."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, event_id long, status string")

    def row(self, key: tuple, us: int, event_id: int, status: str, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "store": [key[1]], "status": [status], "us": [us], "event_id": [event_id], "expired": [expired]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.newest.get() if self.newest.exists() else None
        best = known
        for pdf in rows:
            last = pdf.sort_values(["us", "event_id"]).iloc[-1]
            new = (int(last["us"]), int(last["event_id"]), last["status"])
            if best is None or new[:2] > tuple(best)[:2]:
                best = new
        if best is not known:
            self.newest.update(best)
            if self.idle is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(best[0] // 1000 + self.idle)
            yield self.row(key, *best, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.newest.get()
        self.newest.clear()
        yield self.row(key, *last, True)

    def close(self) -> None:
        pass


def ledger_changes(ledger: DataFrame, delay: str = "10 minutes", idle: int | None = None) -> DataFrame:
    """(doc_id, store, status, ts, event_id, expired): a row whenever the newest status of a key changes.

    ledger is (doc_id, store, status, ts, event_id) without nulls in ts and event_id; newest is by ts, then event_id.
    The state is one row a key.  As a stream, rows of an event_id that was seen within the delay are dropped and so are rows
    later than the delay; a key that shows nothing newer for ``idle`` milliseconds of event time gives a last row with
    expired true and is forgotten.  As a batch every key gives one row, its newest.  Start it inside ``keyed_state``.
    """
    rows = ledger.select("doc_id", "store", "status", "ts", "event_id", F.unix_micros("ts").alias("us"))
    if ledger.isStreaming:
        rows = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    kind = {c: ledger.schema[c].dataType.simpleString() for c in ("doc_id", "store")}
    timed = ledger.isStreaming and idle is not None
    out = f"doc_id {kind['doc_id']}, store {kind['store']}, status string, us long, event_id long, expired boolean"
    changes = rows.groupBy("doc_id", "store").transformWithStateInPandas(NewestStatus(idle if timed else None), out, "Append", "EventTime" if timed else "None")
    return changes.select("doc_id", "store", "status", F.timestamp_micros("us").alias("ts"), "event_id", "expired")
