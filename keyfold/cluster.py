"""Replicated stores on one ring: writes that are placed, fanned out and judged, reads, and rounds of exchange.

Everything goes in bulk, with the replica as a column: a batch of writes is one job for all stores, and so is a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.config import Cluster as Settings
from keyfold.operators import digest, replicate
from keyfold.operators.fold import ENTRY, hashed
from keyfold.operators.ring import Ring, pairs
from keyfold.session import cut
from keyfold.sources.snapshots import LOG_SCHEMA, StateStore

LOG = [c.split()[0] for c in LOG_SCHEMA.split(", ")]


class Cluster:
    """A store for each node of ``ring`` below ``path``. Nodes are configuration: a few, known to the driver."""

    def __init__(self, spark: SparkSession, path: str, ring: Ring, settings: Settings = Settings(), family: str = "xxh64"):  # noqa: B008
        self.spark, self.path, self.ring, self.settings, self.family = spark, path.rstrip("/"), ring, settings, family
        self.rf = 1 if settings.single_node else settings.replication_factor
        self.stores = {n: StateStore(spark, f"{self.path}/{n}", family, log_path=f"{self.path}/log/replica={n}") for n in sorted(ring.weights)}

    def _append(self, rows: DataFrame) -> None:
        rows.select(*LOG, "replica").write.mode("append").partitionBy("replica").parquet(f"{self.path}/log")

    def write(self, log: DataFrame, failed: Column | None = None) -> DataFrame:
        """Send sets and deletes (stamped log rows) to the owners of their keys; ``write_id, owners, failed, ok`` of each, by its ``seq``.

        ``failed``: which messages don't arrive, of ``seq``, ``key``, ``replica`` and ``pos``. A write that failed by the settings' mode still stands where it
        arrived. A delete leaves a tombstone on every owner that it reaches, whether or not there was something to delete (``existed``).
        """
        sent = replicate.fan_out(log, self.ring, self.rf).withColumn("failed", F.lit(False) if failed is None else F.coalesce(failed, F.lit(True)))
        self._append(sent.where(~F.col("failed")))
        mode = "lenient" if self.settings.single_node else self.settings.failure_mode
        return replicate.outcome(sent.select(F.col("seq").alias("write_id"), "replica", "failed"), mode, log.select(F.col("seq").alias("write_id")))

    def states(self) -> DataFrame:
        """``replica`` and the entries of every store."""
        return reduce(DataFrame.unionByName, (s.state().select(F.lit(n).alias("replica"), *ENTRY) for n, s in self.stores.items()))

    def read(self, keys: DataFrame, requester: str | None = None) -> DataFrame:
        """``key, value, replica``: the answer of the first owner that has one; a requester that is an owner answers for itself."""
        return replicate.first_owner_read(keys, self.states(), self.ring, self.rf, requester)

    def existed(self, keys: DataFrame) -> DataFrame:
        """``key, existed``: whether a delete would find something on any owner."""
        return replicate.exists_anywhere(keys, self.states(), self.ring, self.rf)

    def round(self, seed: int | None = None, step: int = 1) -> int:
        """One round of exchange: each node pulls from one peer what it lacks of the keys that it owns; returns how many entries were sent.

        The peer is drawn by ``seed``, or is the node that is ``step`` places further by name. One plan for all nodes: digests by replica,
        then entries of mismatched buckets, of which the older ones lose when the state is folded.
        """
        who = pairs(list(self.stores), seed, step)
        if not who:
            return 0
        mine = hashed(self.states(), self.family)
        table = F.broadcast(self.spark.createDataFrame(who, "me string, peer string"))  # as many rows as nodes
        theirs = mine.join(table, mine["replica"] == table["peer"]).drop("replica", "peer").withColumnRenamed("me", "replica")
        sent = digest.pull(mine, theirs, F.col("replica"), self.ring, self.rf, by=("replica",))
        op = F.when(F.col("tombstone"), "del").otherwise("set")
        rows = cut(sent.select(F.lit(0).cast("long").alias("seq"), op.alias("op"), *(c for c in ENTRY if c != "tombstone"), "replica"))
        self._append(rows)
        return rows.count()

    def snapshot(self) -> None:
        for s in self.stores.values():
            s.snapshot()
