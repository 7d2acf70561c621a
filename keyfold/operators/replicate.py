"""Writes and reads over the owners of a key. Replicas are a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.operators.ring import Ring


def fan_out(writes: DataFrame, ring: Ring, rf: int) -> DataFrame:
    """One row for each write and owner: ``replica`` and ``pos``, its place clockwise. Factors below 1 count as 1."""
    placed = ring.place(writes, max(rf, 1))
    cols = [c for c in writes.columns]
    return placed.select(*cols, F.posexplode("owners").alias("pos", "replica"))


def outcome(attempts: DataFrame, mode: str, writes: DataFrame | None = None) -> DataFrame:
    """``write_id, owners, failed, ok`` of replicated writes, from ``write_id, replica, failed``.

    ``strict``: any failure fails the write. ``lenient``: only failure everywhere does. With ``writes`` (``write_id``), a
    write without owners fails in either mode. A null ``failed`` is a failure. Any other mode is an error.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown replication failure mode: {mode}")
    per = attempts.groupBy("write_id").agg(F.count("*").alias("owners"), F.count_if(F.coalesce("failed", F.lit(True))).alias("failed"))
    if writes is not None:
        per = writes.select("write_id").distinct().join(per, "write_id", "left").select("write_id", F.coalesce("owners", F.lit(0)).alias("owners"), F.coalesce("failed", F.lit(0)).alias("failed"))
    ok = (F.col("owners") > 0) & ((F.col("failed") == 0) if mode == "strict" else (F.col("failed") < F.col("owners")))
    return per.withColumn("ok", ok)


def first_owner_read(keys: DataFrame, states: DataFrame, ring: Ring, rf: int, requester: str | None = None) -> DataFrame:
    """``key, value, replica``: the answer of the first owner, clockwise, that holds a live entry.

    ``states`` has ``replica, key, value, tombstone``, one row for each replica and key. The requester, if it is an owner,
    answers first and its tombstone is final; owners that hold nothing or a tombstone are passed over. Null where none answers.
    """
    placed = ring.place(keys.select("key").distinct(), max(rf, 1))
    asked = placed.select("key", F.posexplode("owners").alias("pos", "replica"))
    held = asked.join(states.select("key", "replica", "value", "tombstone"), ["key", "replica"])
    own = F.lit(False) if requester is None else F.col("replica") == requester
    final = F.min(F.when(own | ~F.col("tombstone"), F.struct(F.when(own, -1).otherwise(F.col("pos")).alias("pos"), F.col("tombstone"), F.col("replica"), F.col("value"))))
    best = held.groupBy("key").agg(final.alias("b"))
    answer = F.when(~F.col("b.tombstone"), F.col("b"))
    return placed.select("key").join(best, "key", "left").select("key", answer["value"].alias("value"), answer["replica"].alias("replica"))


def exists_anywhere(keys: DataFrame, states: DataFrame, ring: Ring, rf: int) -> DataFrame:
    """``key, existed``: whether any owner holds a live entry, which is what a delete in a cluster reports."""
    placed = ring.place(keys.select("key").distinct(), max(rf, 1)).select("key", F.explode("owners").alias("replica"))
    hit = placed.join(states.where(~F.col("tombstone")).select("key", "replica", F.lit(True).alias("hit")), ["key", "replica"], "left")
    return hit.groupBy("key").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("existed"))
