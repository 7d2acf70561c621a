"""Last-write-wins merging of a live feed of mutations.

No watermark is used anywhere: late writes are compared like all others, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from keyfold.functions.hashing import TOMB
from keyfold.operators.fold import ENTRY, as_entries
from keyfold.sources.snapshots import StateStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "value binary, ts long, node_id string, tombstone boolean"
CHANGES = "key string, value binary, ts long, node_id string, tombstone boolean"
_M = (1 << 64) - 1


def _rot(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & _M


def plain_item_hash(key: str | None, value: bytes | None, ts: int, node: str | None, dead: bool) -> int:
    """The item hash of one entry, as an unsigned number."""
    xx = xxhash.xxh64_intdigest
    h = (xx(key.encode()) if key is not None else 0) ^ _rot(ts & _M, 17) ^ (TOMB if dead else 0)
    return h ^ (_rot(xx(node.encode()), 31) if node else 0) ^ (_rot(xx(value), 47) if value else 0)


class Merge(StatefulProcessor):
    """Keeps the greatest entry of each key; emits it whenever it changes. With ``ttl_ms`` an entry that isn't
    written for so long becomes a tombstone, which is emitted too, so that it can travel to other replicas."""

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", STATE)

    @staticmethod
    def _rank(key: str, e: tuple) -> tuple:
        value, ts, node, dead = e
        return ts, (node or "").encode(), plain_item_hash(key, value, ts, node, dead)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name = key[0]
        old = tuple(self.state.get()) if self.state.exists() else None
        best = old
        for f in rows:
            for value, ts, node, dead in zip(f["value"], f["ts"], f["node_id"], f["tombstone"], strict=True):
                if pd.isna(ts):
                    continue
                e = (None if value is None else bytes(value), int(ts), None if pd.isna(node) else node, bool(dead))
                if best is None or self._rank(name, e) > self._rank(name, best):
                    best = e
        if best is not None and best != old:
            self.state.update(best)
            if self.ttl_ms:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
            yield pd.DataFrame([(name, *best)], columns=ENTRY)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            _, ts, node, dead = self.state.get()
            if not dead:
                gone = (None, max(ts + 1, timerValues.getCurrentProcessingTimeInMs() << 16), node, True)
                self.state.update(gone)
                yield pd.DataFrame([(key[0], *gone)], columns=ENTRY)

    def close(self) -> None:
        pass


def merged(feed: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Changed entries of a streaming log, for a sink in update mode. Needs the RocksDB state store."""
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    e = as_entries(feed).select(*ENTRY)
    return e.groupBy("key").transformWithStateInPandas(Merge(ttl_ms), outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def log_feed(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A folder of Parquet log files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def persist(feed: DataFrame, store: StateStore, checkpoint: str, snapshot_every: int = 4, once: bool = True, interval: str = "500 milliseconds") -> StreamingQuery:
    """Append a streaming log to ``store`` batch by batch and take a snapshot every so many batches.

    A batch that is delivered again after a failure is appended again, which the fold doesn't notice. ``once``: process
    what is there and stop; else a batch each ``interval``.
    """
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return feed.writeStream.foreachBatch(_appender(store, snapshot_every)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _appender(store: StateStore, every: int) -> Callable[[DataFrame, int], None]:
    def take(batch: DataFrame, number: int) -> None:
        store.append(batch)
        if every and store.snapshots and number % every == every - 1:
            store.snapshot()

    return take
