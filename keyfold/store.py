"""A key-value store over a shared folder, for programs that want single operations rather than plans."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.config import StoreConfig
from keyfold.functions.clock import after_now, after_update
from keyfold.operators import digest, evict, fold
from keyfold.operators.evict import Lru
from keyfold.operators.ring import Ring
from keyfold.session import cut, shared_path
from keyfold.sources.files import create_once, delete, list_names, read_text
from keyfold.sources.snapshots import LOG_SCHEMA, StateStore
from keyfold.streaming.merge import persist

ACCESS_SCHEMA = "seq long, key string, at long, kind string"


class KVStore:
    """Get, set, delete, exists, and exchange with other stores. Writes are stamped here; bulk work belongs in plans.

    One process writes to a store at a time, as the order of arrival is its counter. With an ``lru`` each hit, set and delete is an
    access, and ``evict`` removes what the accesses push out or let run out.
    """

    def __init__(self, spark: SparkSession, path: str, node_id: str = "node-01", family: str = "xxh64", lru: Lru | None = None, snapshots: bool = True):
        self.spark, self.node_id, self.family, self.lru, self.volatile = spark, node_id, family, lru, False
        self.store = StateStore(spark, path, family, snapshots=snapshots)
        self._seen: list[tuple] = []
        last = self.store.log().agg(F.max("seq"), F.max("ts")).first()
        top = self.store.state().agg(F.max("ts")).first()[0]
        m = self.store._latest()
        self.seq = max(last[0] or 0, m["seq"] if m else 0)
        self.clock = max(last[1] or 0, top or 0)

    @classmethod
    def open(cls, spark: SparkSession, config: StoreConfig) -> KVStore:
        """The store that checked settings describe. Without a log it lives in a folder of its own that goes with ``close``."""
        c = config.check()
        kv = cls(spark, shared_path(spark, "volatile") if c.disable_wal else c.wal_path, c.cluster.node_id or "node-01", lru=c.lru, snapshots=not c.disable_snapshot)
        kv.volatile = c.disable_wal
        return kv

    def follow(self, feed: DataFrame, checkpoint: str, config: StoreConfig, once: bool = True):
        """Append a stream of mutations every ``wal_interval``, with a snapshot every ``snapshot_interval``."""
        every = max(1, config.snapshot_interval // config.wal_interval) if self.store.snapshots else 0
        return persist(feed, self.store, checkpoint, every, once, f"{config.wal_interval} milliseconds")

    def close(self) -> None:
        """Keep what was seen and take a snapshot, or, if the store is volatile, leave nothing."""
        if self.volatile:
            delete(self.spark, self.store.path)
            return
        self._flush()
        if self.store.snapshots:
            self.store.snapshot()

    def _access(self, key: str, kind: str, now_ms: int | None = None) -> None:
        if self.lru is not None:
            self._seen.append((key, int(time.time() * 1000) if now_ms is None else now_ms, kind))

    def _flush(self) -> None:
        """Write the accesses since the last time, in order."""
        if self._seen:
            first = time.time_ns()
            rows = [(first + i, *a) for i, a in enumerate(self._seen)]
            self.spark.createDataFrame(rows, ACCESS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.store.path}/accesses")
            self._seen = []

    def take_accesses(self, accesses: DataFrame) -> None:
        """Accesses (``seq, key, at, kind``) that were recorded elsewhere."""
        accesses.select("seq", "key", "at", "kind").write.mode("append").parquet(f"{self.store.path}/accesses")

    def _held(self) -> tuple[int, list[str], DataFrame]:
        """Version of the cache, the access files that it has taken in, and what it held."""
        at = f"{self.store.path}/cache"
        names = [n for n in list_names(self.spark, at) if n.endswith(".json")]
        if not names:
            return 0, [], self.spark.createDataFrame([], ACCESS_SCHEMA)
        m = json.loads(read_text(self.spark, f"{at}/{names[-1]}"))
        return m["version"], m["files"], self.spark.read.schema(ACCESS_SCHEMA).parquet(m["data"])

    def evict(self, now_ms: int | None = None) -> int:
        """Remove what has left the cache by ``now_ms``; returns how many keys it holds.

        Accesses since the last eviction are replayed on top of what the cache held then, which is kept as one row a key. What was
        pushed out for want of room is gone; what ran out becomes a tombstone, whatever its clock. Both take effect with a snapshot;
        without snapshots both are deletes in the log.
        """
        if self.lru is None:
            raise ValueError("the store has no LRU")
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        self._flush()
        version, covered, held = self._held()
        files = [n for n in list_names(self.spark, f"{self.store.path}/accesses") if not n.startswith(("_", "."))]
        new = [f"{self.store.path}/accesses/{n}" for n in files if n not in set(covered)]
        if new:
            held = held.unionByName(self.spark.read.schema(ACCESS_SCHEMA).parquet(*new))
        fates = cut(evict.fates(held, self.lru, self.family, now_ms))
        out = {why: fates.where(F.col("reason") == why).select("key") for why in ("capacity", "ttl")}
        stamp = self._now()
        if self.store.snapshots:
            self.store.snapshot(lambda e: evict.tombstones(evict.tombstones(e, out["capacity"], "capacity", stamp, self.node_id), out["ttl"], "ttl", stamp, self.node_id))
        else:
            gone = self.store.state().join(out["capacity"].unionByName(out["ttl"]), "key", "left_semi").where(~F.col("tombstone"))
            self.push(gone.select("key", F.lit(None).cast("binary").alias("value"), F.greatest(F.lit(stamp), F.col("ts") + 1).alias("ts"), F.lit(self.node_id).alias("node_id"), F.lit(True).alias("tombstone")))
        data = f"{self.store.path}/cache/v{version + 1}"
        last = held.where("kind = 'seen'").groupBy("key").agg(F.max("seq").alias("seq"))
        fates.where("reason = 'resident'").join(last, "key").select("seq", "key", "at", F.lit("seen").alias("kind")).write.mode("overwrite").parquet(data)
        if not create_once(self.spark, f"{self.store.path}/cache/{version + 1:012d}.json", json.dumps({"version": version + 1, "files": files, "data": data})):
            raise RuntimeError("another process evicts from this store")
        return self.spark.read.schema(ACCESS_SCHEMA).parquet(data).count()

    def occupancy(self) -> float:
        """How full the cache was after the last eviction; 0 without an LRU."""
        return self._held()[2].count() / (self.lru.per_shard * self.lru.shards) if self.lru else 0.0

    def _write(self, rows: list[tuple]) -> None:
        out = []
        for op, key, value, ts, node in rows:
            self.seq += 1
            out.append((self.seq, op, key, None if value is None else bytearray(value), ts, node))
        self.store.append(self.spark.createDataFrame(out, LOG_SCHEMA).coalesce(1))

    def _now(self) -> int:
        self.clock = after_now(self.clock, int(time.time() * 1000))
        return self.clock

    def get(self, key: str) -> bytes | None:
        """The payload, or None for a key that is absent or deleted; an empty payload is ``b""``."""
        r = self.store.state().where((F.col("key") == key) & ~F.col("tombstone")).select("value").first()
        if r is None:
            return None
        self._access(key, "seen")
        return bytes(r[0] or b"")

    def exists(self, key: str) -> bool:
        return not self.store.state().where((F.col("key") == key) & ~F.col("tombstone")).isEmpty()

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return fold.multi_get(self.store.state(), keys)

    def set(self, key: str, value: bytes | None) -> None:
        self._access(key, "seen")
        self._write([("set", key, value, self._now(), self.node_id)])

    def set_many(self, pairs: dict[str, bytes | None]) -> None:
        for k in pairs:
            self._access(k, "seen")
        self._write([("set", k, v, self._now(), self.node_id) for k, v in pairs.items()])

    def delete(self, key: str) -> bool:
        """Whether there was something to delete; if not, nothing is written."""
        if not self.exists(key):
            return False
        self._access(key, "delete")
        self._write([("del", key, None, self._now(), self.node_id)])
        return True

    def apply(self, op: str, key: str, value: bytes | None, ts: int, node_id: str | None) -> None:
        """A write stamped elsewhere; it counts even where its clock isn't believed."""
        self.clock = after_update(self.clock, ts, int(time.time() * 1000))
        self._write([(op, key, value, ts, node_id)])

    def hashed(self) -> DataFrame:
        return fold.hashed(self.store.state(), self.family)

    def root(self) -> int:
        return digest.root_of_sums(self.store.digests()).first()["digest"]

    def pull_for(self, requester: KVStore, ring: Ring | None = None, rf: int = 3) -> DataFrame:
        """Entries that this store sends to ``requester``; none if the states are equal."""
        return digest.pull(requester.hashed(), self.hashed(), requester.node_id, ring, rf)

    def push(self, entries: DataFrame) -> None:
        """Take in entries of another store; older ones lose as always."""
        rows = entries.select("key", "value", "ts", "node_id", "tombstone")
        n = rows.count()
        op = F.when(F.col("tombstone"), "del").otherwise("set")
        numbered = rows.select((F.monotonically_increasing_id() + self.seq + 1).alias("seq"), op.alias("op"), "key", "value", "ts", "node_id")
        self.store.append(numbered)
        if n:
            self.seq = self.store.log().agg(F.max("seq")).first()[0]

    def sync_from(self, peer: KVStore, ring: Ring | None = None, rf: int = 3) -> None:
        """One round of exchange in one direction."""
        self.push(cut(peer.pull_for(self, ring, rf)))

    def snapshot(self) -> int:
        return self.store.snapshot()
