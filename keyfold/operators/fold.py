"""Last-write-wins key state: folding a log of mutations, reading it, and judging each write of it.

A log has ``seq, op, key, value, ts, node_id``, where ``op`` is ``set`` or ``del`` and ``seq`` the order of arrival. An
entry has ``key, value, ts, node_id, tombstone``. The order of writes is (clock, node id by bytes, item hash unsigned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.functions.hashing import item_hash, key_hash, shard_of, sub_of, unsigned_order
from keyfold.operators.running import running

ENTRY = ["key", "value", "ts", "node_id", "tombstone"]


def rank(family: str = "xxh64") -> Column:
    """The total order of entries as a struct that compares column by column."""
    h = item_hash(key_hash(F.col("key"), family), F.col("ts"), F.col("node_id"), F.col("value"), F.col("tombstone"), family)
    return F.struct(F.col("ts").alias("ts"), F.coalesce("node_id", F.lit("")).alias("node"), unsigned_order(h).alias("hash"))


def as_entries(log: DataFrame, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The writes of a log in the form of entries, with those of the columns ``keep`` that it has; a delete has no payload."""
    dead = F.col("op") == "del"
    rest = [c for c in keep if c in log.columns]
    return log.where(F.col("op").isin("set", "del")).select("key", F.when(~dead, F.col("value")).alias("value"), "ts", "node_id", dead.alias("tombstone"), *rest)


def fold(entries: DataFrame, family: str = "xxh64", by: tuple[str, ...] = ()) -> DataFrame:
    """The greatest entry of every key, or of every key of each group ``by``, such as a replica. The result is the same for any order and any repetition of the input.

    Nulls: a null key is a key, a null node id is the empty one, a null clock loses to any other; null and
    empty payloads rank alike, and of such twins the empty one stays. Folds before its one shuffle.
    """
    w = F.max(F.struct(rank(family).alias("rank"), F.struct("value", "node_id").alias("v"), F.col("tombstone")))
    return entries.groupBy(*by, "key").agg(w.alias("w")).select(*by, "key", F.col("w.v.value").alias("value"), F.col("w.rank.ts").alias("ts"), F.col("w.v.node_id").alias("node_id"), F.col("w.tombstone").alias("tombstone"))


def replay_by_clock(log: DataFrame) -> DataFrame:
    """Fold by the clock alone: of equal clocks the first to arrive stays, and node ids are lost."""
    w = F.max(F.struct("ts", (-F.col("seq")).alias("s"), "value", "tombstone"))
    return as_entries(log).groupBy("key").agg(w.alias("w")).select("key", "w.value", "w.ts", F.lit(None).cast("string").alias("node_id"), "w.tombstone")


def overwrite(log: DataFrame) -> DataFrame:
    """State if every write simply replaces what was there: the last to arrive of each key."""
    w = F.max(F.struct("seq", "value", "ts", "node_id", "tombstone"))
    return as_entries(log).groupBy("key").agg(w.alias("w")).select("key", "w.value", "w.ts", "w.node_id", "w.tombstone")


def remove(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries without those of ``keys``; no tombstone stays. A null key is removed only by a null key."""
    out = keys.select("key").distinct().select(F.coalesce("key", F.lit("")).alias("__k"), F.col("key").isNull().alias("__none"))
    e = entries.withColumn("__k", F.coalesce("key", F.lit(""))).withColumn("__none", F.col("key").isNull())
    return e.join(out, ["__k", "__none"], "left_anti").select(*entries.columns)


def live(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("tombstone"))


def get(log: DataFrame, key: str, family: str = "xxh64") -> DataFrame:
    """The live entry of one key. The filter reaches the scan, so only that key is folded."""
    return live(fold(as_entries(log.where(F.col("key") == key)), family))


def multi_get(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, value, found`` for every row of ``keys``; tombstones are not found."""
    return keys.select("key").join(live(entries).select("key", "value", F.lit(True).alias("found")), "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def scan_buckets(hashed: DataFrame, shard: int, subs: list[int]) -> DataFrame:
    """Entries of some buckets of a shard; a shard that doesn't exist has none."""
    return hashed.where((F.col("shard") == shard) & F.col("sub").isin(subs))


def hashed(entries: DataFrame, family: str = "xxh64") -> DataFrame:
    """Entries with ``key_hash, item_hash, shard, sub``."""
    kh = key_hash(F.col("key"), family)
    return (
        entries.withColumn("key_hash", kh)
        .withColumn("item_hash", item_hash(F.col("key_hash"), F.col("ts"), F.col("node_id"), F.col("value"), F.col("tombstone"), family))
        .withColumn("shard", shard_of(F.col("key_hash")))
        .withColumn("sub", sub_of(F.col("key_hash")))
    )


def judged(log: DataFrame, family: str = "xxh64") -> DataFrame:
    """Every write in the order of arrival with ``accepted``: it is greater than all earlier writes of its key."""
    e = as_entries(log).withColumn("__rank", rank(family))
    r = running(e, ["key"], "seq", F.col("__rank"), "__best", F.max)
    return r.select("seq", *ENTRY, (F.col("__best").isNull() | (F.col("__rank") > F.col("__best"))).alias("accepted"))


def deletes_existed(log: DataFrame, cluster: bool = False) -> DataFrame:
    """Every delete, taken as a command in order of arrival: ``seq, key, existed, writes``.

    ``existed``: the last command on the key before it was a set. On a single node only then is a tombstone written; in
    a cluster it is always.
    """
    cmd = log.where(F.col("op").isin("set", "del")).select("seq", "op", "key")
    r = running(cmd, ["key"], "seq", F.struct("seq", (F.col("op") == "set").alias("live")), "__last", F.max)
    existed = F.coalesce(F.col("__last.live"), F.lit(False))
    return r.where("op = 'del'").select("seq", "key", existed.alias("existed"), (F.lit(True) if cluster else existed).alias("writes"))


def stamp(commands: DataFrame, node: str, clock: Column) -> DataFrame:
    """Commands (``op, key, value``) as log rows of ``node`` at ``clock``; what the caller says about either is ignored."""
    return commands.select("seq", "op", "key", "value", clock.alias("ts"), F.lit(node).alias("node_id"))
