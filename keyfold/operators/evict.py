"""Bounding key state by capacity and by age of the last access.

Accesses have ``seq, key, at`` (milliseconds) and ``kind`` (``seen`` or ``delete``).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.hashing import key_hash, unsigned_mod


@dataclass(frozen=True)
class Lru:
    """Capacity in keys, age in milliseconds (0: none) and shards; there are no more shards than capacity.

    With a ``jitter_seed`` each access lives up to a tenth of the age longer, by its hash, so that keys seen together don't run out together."""

    capacity: int = 10_000
    ttl_ms: int = 24 * 3600 * 1000
    shards: int = 16
    jitter_seed: int | None = None

    def __post_init__(self):
        if self.capacity <= 0:
            raise ValueError("LRU capacity must be greater than 0")
        if self.shards <= 0:
            raise ValueError("LRU shard count must be greater than 0")
        object.__setattr__(self, "shards", min(self.shards, self.capacity))

    @property
    def per_shard(self) -> int:
        return self.capacity // self.shards


def lru_shard(key: Column, lru: Lru, family: str = "xxh64") -> Column:
    return unsigned_mod(key_hash(key, family), lru.shards)


def last_seen(accesses: DataFrame) -> DataFrame:
    """``key, at, seq`` of the last access of every key that was not deleted since."""
    last = accesses.where("key is not null").groupBy("key").agg(F.max(F.struct("seq", "at", "kind")).alias("w"))
    return last.where("w.kind = 'seen'").select("key", "w.at", "w.seq")


def recent(accesses: DataFrame, lru: Lru, family: str = "xxh64") -> DataFrame:
    """``key, shard, at``: of every shard the ``per_shard`` keys seen last, whatever was deleted or ran out on the way.

    Spark cuts each task's rows to that many before the shuffle.
    """
    seen = last_seen(accesses.where("kind = 'seen'")).withColumn("shard", lru_shard(F.col("key"), lru, family))
    w = Window.partitionBy("shard").orderBy(F.col("seq").desc())
    return seen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= lru.per_shard).select("key", "shard", "at")


def not_recent(accesses: DataFrame, lru: Lru, family: str = "xxh64") -> DataFrame:
    """``key``: seen at some time and not among ``recent``."""
    keys = accesses.where("kind = 'seen' and key is not null").select("key").distinct()
    return keys.join(recent(accesses, lru, family).select("key"), "key", "left_anti")


def _only_seen(accesses: DataFrame, lru: Lru) -> bool:
    """Whether nothing can leave but for want of room, so that ``recent`` is what the cache holds."""
    return lru.ttl_ms == 0 and accesses.where("kind = 'delete' and key is not null").isEmpty()


def fates(accesses: DataFrame, lru: Lru, family: str = "xxh64", now_ms: int | None = None) -> DataFrame:
    """``key, at, reason``: what became of every key that was ever cached, once all has left that ran out by ``now_ms`` (null:
    the time of the last access): ``resident``, ``capacity``, ``ttl`` or ``delete``. ``at`` is when it was seen last."""
    last = F.max_by(F.struct("at", "reason"), F.coalesce("seq", F.lit((1 << 63) - 1))).alias("w")  # no seq: in the end
    return _replay(accesses, lru, family, True, now_ms).groupBy("key").agg(last).select("key", "w.at", "w.reason")


def published(accesses: DataFrame, fill: float, seed: int = 0) -> DataFrame:
    """The accesses that are still published when a queue is ``fill`` full: a seeded share of them, all of a delete's."""
    share = sampled_share(F.lit(float(fill)))
    return accesses.where((F.col("kind") == "delete") | (F.pmod(F.xxhash64(F.lit(seed), "key", "seq"), F.lit(1 << 20)) < share * (1 << 20)))


def resident(accesses: DataFrame, lru: Lru, family: str = "xxh64") -> DataFrame:
    """``key, shard, at``: what the cache holds in the end, after what has run out at the time of the last access left.

    With deletes or an age, room that became free brings no key back, so the accesses are replayed like in ``events``.
    """
    if _only_seen(accesses, lru):
        return recent(accesses, lru, family)
    return _replay(accesses, lru, family, True).where("reason = 'resident'").select("key", "shard", "at")


def evicted(accesses: DataFrame, lru: Lru, family: str = "xxh64") -> DataFrame:
    """``key``: pushed out or run out at some time and neither back since nor, once back, deleted."""
    if _only_seen(accesses, lru):
        return not_recent(accesses, lru, family)
    return fates(accesses, lru, family).where("reason in ('ttl', 'capacity')").select("key")


def expired(accesses: DataFrame, now_ms: int, lru: Lru) -> DataFrame:
    """``key, at``: last seen ``ttl_ms`` or longer before ``now_ms``. Without an age nothing expires."""
    seen = last_seen(accesses).select("key", "at")
    return seen.where(F.lit(lru.ttl_ms > 0) & (F.col("at") + lru.ttl_ms <= now_ms))


def lifetimes(accesses: DataFrame, gap_ms: int) -> DataFrame:
    """``key, born, dies, accesses``: stretches of accesses, each of which came before the age since the last ran out."""
    at = F.timestamp_millis(F.col("at"))
    g = accesses.where("kind = 'seen'").select("key", at.alias("t")).groupBy("key", F.session_window("t", f"{gap_ms} milliseconds").alias("s"))
    return g.agg(F.count("*").alias("accesses")).select("key", F.col("s.start").alias("born"), F.col("s.end").alias("dies"), "accesses")


def events(accesses: DataFrame, lru: Lru, family: str = "xxh64") -> DataFrame:
    """``seq, shard, key, reason``: every eviction in order, with the access at which it happened.

    Exact for deletes and ages too: before each access the shard's oldest keys that have run out leave (``ttl``), and
    a new key in a full shard pushes out the oldest (``capacity``). A shard is a sequence by nature; it streams through one
    task that holds ``per_shard`` keys, so more shards are the way to more tasks.
    """
    return _replay(accesses, lru, family, False).select("seq", "shard", "key", "reason")


def _replay(accesses: DataFrame, lru: Lru, family: str, whole: bool, now_ms: int | None = None) -> DataFrame:
    """``seq, shard, key, at, reason``: the evictions; if ``whole`` also deletes of cached keys (``delete``) and, without a
    ``seq``, what runs out by the time of the last access and what remains (``resident``). ``at`` is when the key was seen last."""
    cap, ttl = lru.per_shard, lru.ttl_ms
    end = (accesses.agg(F.max("at")).first()[0] if now_ms is None else now_ms) if whole and ttl else None

    def close(shard: int | None, cache: OrderedDict) -> list[tuple]:
        out = []
        while end is not None and cache and next(iter(cache.values()))[1] <= end:
            key, (at, _) = cache.popitem(last=False)
            out.append((None, shard, key, at, "ttl"))
        return out + [(None, shard, key, at, "resident") for key, (at, _) in cache.items()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, cache = None, OrderedDict()
        frame = lambda out: pd.DataFrame(out, columns=["seq", "shard", "key", "at", "reason"]).astype({"seq": "Int64"})
        for f in frames:
            out = []
            for s, seq, key, at, kind, late in zip(f["shard"], f["seq"], f["key"], f["at"], f["kind"], f["late"], strict=True):
                if s != shard:
                    if whole:
                        out += close(shard, cache)
                    shard, cache = s, OrderedDict()
                while ttl and cache and next(iter(cache.values()))[1] <= at:
                    old, (was, _) = cache.popitem(last=False)
                    out.append((seq, s, old, was, "ttl"))
                if kind == "delete":
                    was = cache.pop(key, None)
                    if whole and was is not None:
                        out.append((seq, s, key, was[0], "delete"))
                    continue
                if key not in cache and len(cache) >= cap:
                    old, (was, _) = cache.popitem(last=False)
                    out.append((seq, s, old, was, "capacity"))
                cache[key] = (at, at + ttl + late)
                cache.move_to_end(key)
            yield frame(out)
        if whole:
            yield frame(close(shard, cache))

    spread = max(1, ttl // 10)
    late = F.lit(0) if lru.jitter_seed is None else F.pmod(F.xxhash64(F.lit(lru.jitter_seed), "key", "seq"), F.lit(spread))
    d = accesses.where("key is not null").select(lru_shard(F.col("key"), lru, family).alias("shard"), "seq", "key", "at", "kind", late.alias("late"))
    return d.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(run, "seq long, shard int, key string, at long, reason string")


def tombstones(entries: DataFrame, out: DataFrame, reason: str, now_ts: int, node: str) -> DataFrame:
    """State after evictions: for ``capacity`` the keys are gone, for ``ttl`` they are tombstones whatever their clock."""
    if reason == "capacity":
        return entries.join(out.select("key"), "key", "left_anti")
    if reason != "ttl":
        raise ValueError(f"unknown reason: {reason}")
    hit = entries.join(out.select("key", F.lit(True).alias("__out")), "key", "left")
    gone = F.coalesce("__out", F.lit(False))
    return hit.select(
        "key", F.when(~gone, F.col("value")).alias("value"), F.when(gone, F.lit(now_ts).cast("long")).otherwise(F.col("ts")).alias("ts"),
        F.when(gone, F.lit(node)).otherwise(F.col("node_id")).alias("node_id"), (gone | F.col("tombstone")).alias("tombstone"),
    )


def occupancy(residents: DataFrame, lru: Lru) -> DataFrame:
    """``cached, capacity, occupancy`` over all shards."""
    room = lru.per_shard * lru.shards
    return residents.agg(F.count("*").alias("cached")).select("cached", F.lit(room).cast("long").alias("capacity"), (F.col("cached") / room).alias("occupancy"))


def ring_weight(occupancy_: Column) -> Column:
    """Weight of a node on the ring by how full it is."""
    return F.when(occupancy_ >= 0.90, 16).when(occupancy_ >= 0.80, 64).otherwise(128)


def weight_changes(samples: DataFrame) -> DataFrame:
    """``node_id, seq, weight`` where a node's weight differs from the one before; a node starts with 128."""
    w = Window.partitionBy("node_id").orderBy("seq")  # one sample every few seconds
    d = samples.withColumn("weight", ring_weight(F.col("occupancy")))
    return d.withColumn("old", F.coalesce(F.lag("weight").over(w), F.lit(128))).where("weight != old").select("node_id", "seq", "weight")


def sampled_share(fill: Column) -> Column:
    """The share of accesses that are still published when a shard's queue is ``fill`` full."""
    # Upper ends of the ten tiers; each halves the share of the one before.
    ends = [0.01, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80]
    out = F.lit(0.0)
    for i in reversed(range(len(ends))):
        out = F.when(fill < ends[i], 0.5 ** (i + 1)).otherwise(out)
    return out
