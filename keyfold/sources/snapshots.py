"""Versioned snapshots of key state and the log tail after each, in one shared folder.

A version is a Parquet folder and a manifest that can be created only once; the manifest names the log files that the
snapshot covers, whatever the order in which their rows came. Readers see the newest manifest, so a snapshot appears whole or not at all.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators import digest
from keyfold.operators.fold import ENTRY, hashed
from keyfold.operators.recovery import recover
from keyfold.sources.files import create_once, delete, exists, list_names, make_dir, read_text

ENTRY_SCHEMA = "key string, value binary, ts long, node_id string, tombstone boolean"
SUMS_SCHEMA = "shard int, sub int, x long, cnt long"
LOG_SCHEMA = "seq long, op string, key string, value binary, ts long, node_id string"


class StateStore:
    """``path`` holds ``log/`` (Parquet appended by writers), ``snapshots/vN`` and ``manifest/``. ``family``: hash family of ties; ``log_path``: another place of the log."""

    def __init__(self, spark: SparkSession, path: str, family: str = "xxh64", durable_log: bool = True, snapshots: bool = True, log_path: str | None = None):
        self.spark, self.path, self.family = spark, path.rstrip("/"), family
        self.log_path = (log_path or f"{self.path}/log").rstrip("/")
        self.durable_log, self.snapshots = durable_log, snapshots
        make_dir(spark, f"{self.path}/manifest")
        make_dir(spark, self.log_path)

    def append(self, log: DataFrame) -> None:
        if self.durable_log:
            log.select(*[c.split()[0] for c in LOG_SCHEMA.split(", ")]).write.mode("append").parquet(self.log_path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)

    def _latest(self) -> dict | None:
        names = [n for n in list_names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{names[-1]}")) if names else None

    def _files(self) -> list[str]:
        return [n for n in list_names(self.spark, self.log_path) if not n.startswith(("_", "."))]

    def _tail(self, m: dict | None, files: list[str]) -> DataFrame:
        """Rows of those of ``files`` that the snapshot of manifest ``m`` doesn't cover."""
        covered = set(m.get("files", [])) if m else ()
        new = [f"{self.log_path}/{n}" for n in files if n not in covered]
        if not new:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        rows = self.spark.read.schema(LOG_SCHEMA).parquet(*new)
        return rows.where(F.col("seq") > m["seq"]) if m and "files" not in m else rows  # written before files were named

    def state(self) -> DataFrame:
        """Entries recovered from the newest snapshot and the log after it."""
        m = self._latest()
        if m is None:
            base = self.spark.createDataFrame([], ENTRY_SCHEMA)
        else:
            base = self.spark.read.schema(ENTRY_SCHEMA).parquet(m["data"])
        return recover(base, self._tail(m, self._files()), self.family)

    def snapshot(self, edit: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Write a new version; returns its number. Log rows appended since stay in the tail, however small their ``seq``.

        ``edit`` changes the entries on their way, such as by what eviction removes. The digests of all buckets are written beside them."""
        if not self.snapshots:
            raise RuntimeError("snapshots are disabled")
        m = self._latest()
        files = self._files()
        tail = self._tail(m, files)
        seq = tail.agg(F.max("seq")).first()[0]
        version = 1 if m is None else m["version"] + 1
        covered = max(x for x in (seq, m["seq"] if m else None, -(1 << 62)) if x is not None)
        base = self.spark.createDataFrame([], ENTRY_SCHEMA) if m is None else self.spark.read.schema(ENTRY_SCHEMA).parquet(m["data"])
        data = f"{self.path}/snapshots/v{version}"
        entries = recover(base, tail, self.family)
        (edit(entries) if edit else entries).select(*ENTRY).write.mode("overwrite").parquet(data)
        written = self.spark.read.schema(ENTRY_SCHEMA).parquet(data)
        digest.sums(hashed(written, self.family)).write.mode("overwrite").parquet(f"{data}-digests")
        if not create_once(self.spark, f"{self.path}/manifest/{version:012d}.json", json.dumps({"version": version, "seq": covered, "files": files, "data": data})):
            raise RuntimeError(f"version {version} was written by another process")
        return version

    def digests(self) -> DataFrame:
        """Bucket sums of the state: those of the newest snapshot, out of which and into which only entries of keys in the log's tail are taken."""
        m = self._latest()
        if m is None or not exists(self.spark, f"{m['data']}-digests"):
            return digest.sums(hashed(self.state(), self.family))
        tail = self._tail(m, self._files())
        keys = tail.select("key").distinct().select(F.col("key").alias("__key"))
        old = self.spark.read.schema(ENTRY_SCHEMA).parquet(m["data"]).join(keys, F.col("key").eqNullSafe(F.col("__key")), "left_semi")
        before = self.spark.read.schema(SUMS_SCHEMA).parquet(f"{m['data']}-digests")
        return digest.update_digests(before, hashed(old, self.family), hashed(recover(old, tail, self.family), self.family))

    def clear_log(self) -> None:
        """Drop the log files that the newest snapshot covers; none, if it is of a time when files weren't named."""
        m = self._latest()
        for n in m.get("files", []) if m else []:
            delete(self.spark, f"{self.log_path}/{n}")

    def has(self, version: int) -> bool:
        return exists(self.spark, f"{self.path}/manifest/{version:012d}.json")
