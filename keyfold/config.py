"""Settings of a store and of its cluster, with the checks that building one makes."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, fields, replace
from hashlib import sha256

from keyfold.operators.evict import Lru


@dataclass(frozen=True)
class Cluster:
    bind_addr: str = "127.0.0.1"
    bind_port: int = 7946
    grpc_port: int = 50051
    node_id: str = ""
    single_node: bool = False
    replication_factor: int = 3
    failure_mode: str = "strict"
    seeds: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "replication_factor", max(1, self.replication_factor))


@dataclass(frozen=True)
class StoreConfig:
    """Times are milliseconds. ``default()`` gives the usual values; a bare instance has nothing set."""

    wal_path: str = ""
    snapshot_path: str = ""
    wal_interval: int = 0
    snapshot_interval: int = 0
    wal_buffer: int = 0
    wal_segments: int = 0
    gossip_interval: int = 0
    lru: Lru | None = None
    insecure: bool = False
    credentials: str | None = None
    clock: str | None = None
    disable_wal: bool = False
    disable_snapshot: bool = False
    cluster: Cluster = Cluster(bind_addr="", replication_factor=1, failure_mode="")

    @classmethod
    def default(cls) -> StoreConfig:
        return cls(
            wal_path="data/wal", snapshot_path="data/snapshot.bin", wal_interval=500, snapshot_interval=300_000, wal_buffer=64 * 1024, wal_segments=16,
            gossip_interval=10_000, lru=Lru(), clock="hlc", cluster=Cluster(node_id=sha256(uuid.uuid4().bytes).hexdigest()),
        )

    def set(self, **changes) -> StoreConfig:
        """With some settings changed; those of the cluster are found by their own names."""
        own = {f.name for f in fields(self)}
        inner = {k: v for k, v in changes.items() if k not in own}
        return replace(self, **{k: v for k, v in changes.items() if k in own}, **({"cluster": replace(self.cluster, **inner)} if inner else {}))

    def volatile(self) -> StoreConfig:
        return self.set(disable_wal=True, disable_snapshot=True)

    @classmethod
    def layered(cls, flags: dict, env: dict | None = None, prefix: str = "KEYFOLD_") -> StoreConfig:
        """Defaults, over which go environment variables and then flags."""
        env = os.environ if env is None else env
        base = cls.default()
        kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)} | {f.name: type(getattr(base.cluster, f.name)) for f in fields(base.cluster)}
        told = {}
        for name, kind in kinds.items():
            if (v := env.get(prefix + name.upper())) is not None and kind in (str, int, bool):
                told[name] = v.lower() in ("1", "true", "yes") if kind is bool else kind(v)
        return base.set(**{**told, **{k: v for k, v in flags.items() if v is not None}})

    def check(self) -> StoreConfig:
        """Raise ValueError for the first setting that is missing."""
        needed = [
            ("wal_path", self.wal_path), ("snapshot_path", self.snapshot_path), ("wal_interval", self.wal_interval), ("snapshot_interval", self.snapshot_interval),
            ("credentials or insecure", self.insecure or self.credentials), ("wal_buffer", self.wal_buffer), ("wal_segments", self.wal_segments),
            ("clock", self.clock), ("bind_addr", self.cluster.bind_addr),
        ]
        if not self.cluster.single_node:
            needed += [("gossip_interval", self.gossip_interval), ("failure_mode", self.cluster.failure_mode)]
        for name, value in needed:
            if not value:
                raise ValueError(f"{name} must be set")
        if self.cluster.failure_mode not in ("", "strict", "lenient"):
            raise ValueError(f"unknown failure_mode: {self.cluster.failure_mode}")
        return self
