"""Placement of keys on nodes by consistent hashing.

The ring is configuration: nodes and their weights. It is laid out by the driver, which checks its size, as a table of
PREFIXES buckets of hash values; a key finds its vnode by an equi-join on its bucket and a look through the few vnodes
there. Keys are never held against all vnodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.hashing import hex_hash

DEFAULT_WEIGHT = 128
#: Hex digits that make a bucket; 16 ** 3 buckets.
DIGITS = 3
MAX_VNODES = 1_000_000
#: Bytes of owner lists up to which the bucket table is broadcast, a name counting 16 besides its own; beyond it is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _hash(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()[:16]


class Ring:
    """Vnodes in the order of their hashes. A null or negative weight is 128, weight 0 keeps a node off the ring."""

    def __init__(self, weights: dict[str, int | None]):
        self.weights = {n: DEFAULT_WEIGHT if w is None or w < 0 else w for n, w in weights.items()}
        if sum(self.weights.values()) > MAX_VNODES:
            raise ValueError(f"a ring of more than {MAX_VNODES} vnodes")
        self.vnodes = sorted((_hash(f"{n}-{j}"), n, j) for n, w in self.weights.items() for j in range(w))
        self._at = [v[0] for v in self.vnodes]

    @classmethod
    def of(cls, nodes: DataFrame) -> Ring:
        """From ``node_id, weight``; rows without a node id are left out, a repeated node counts with its greatest weight."""
        rows = nodes.where("node_id is not null").groupBy("node_id").agg(F.max("weight").alias("w")).limit(MAX_VNODES + 1).collect()
        return cls({r["node_id"]: r["w"] for r in rows})

    def reweighted(self, node: str, weight: int) -> Ring:
        """With another weight of a node; an unknown node changes nothing."""
        return Ring({**self.weights, node: weight}) if node in self.weights else self

    def added(self, weights: dict[str, int | None]) -> Ring:
        """With further nodes; known ones keep their weight."""
        return Ring({**weights, **self.weights})

    def removed(self, node: str) -> Ring:
        return Ring({n: w for n, w in self.weights.items() if n != node})

    def owners_at(self, i: int, rf: int) -> list[str]:
        """Distinct nodes clockwise from vnode ``i``."""
        out: list[str] = []
        nodes = len({n for _, n, _ in self.vnodes})
        for step in range(len(self.vnodes)):
            if len(out) >= min(rf, nodes):
                break
            n = self.vnodes[(i + step) % len(self.vnodes)][1]
            if n not in out:
                out.append(n)
        return out

    def owners(self, key: str, rf: int) -> list[str]:
        """Owners of one key, for tests and single lookups."""
        if not self.vnodes or rf <= 0:
            return []
        return self.owners_at(bisect_left(self._at, _hash(key)) % len(self.vnodes), rf)

    def vnode_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, j, h) for h, n, j in self.vnodes], "node_id string, vnode int, vhash string")

    def place(self, keys: DataFrame, rf: int = 1, key: Column | str = "key") -> DataFrame:
        """``keys`` with ``owners``, the first ``rf`` distinct nodes clockwise. A null key has null owners; an empty ring
        or ``rf`` below 1 gives none."""
        spark = keys.sparkSession
        key = F.col(key) if isinstance(key, str) else key
        if not self.vnodes or rf <= 0:
            return keys.withColumn("owners", F.when(key.isNotNull(), F.array().cast("array<string>")))
        cells: dict[str, list] = {}
        for i, (h, _, _) in enumerate(self.vnodes):
            cells.setdefault(h[:DIGITS], []).append((h, self.owners_at(i, rf)))
        table, following = [], (None, self.owners_at(0, rf))
        for b in range(16**DIGITS - 1, -1, -1):
            own = cells.get(f"{b:0{DIGITS}x}", [])
            table.append((f"{b:0{DIGITS}x}", [*own, ("g" * 16, following[1])]))  # sorts after every hash
            following = own[0] if own else following
        buckets = spark.createDataFrame(table, "__b string, __v array<struct<h: string, o: array<string>>>")
        d = keys.withColumn("__h", hex_hash(key)).withColumn("__b", F.substring("__h", 1, DIGITS))
        size = sum(16 + len(n) for _, v in table for h, o in v for n in (h, *o))
        found = d.join(F.broadcast(buckets) if size <= BROADCAST_BYTES else buckets, "__b", "left")
        return found.withColumn("owners", F.filter("__v", lambda v: v["h"] >= F.col("__h"))[0]["o"]).drop("__h", "__b", "__v")

    def owner(self, keys: DataFrame, key: Column | str = "key") -> DataFrame:
        """``keys`` with ``owner``; the empty string on an empty ring."""
        if not self.vnodes:
            return keys.withColumn("owner", F.lit(""))
        return self.place(keys, 1, key).withColumn("owner", F.col("owners")[0]).drop("owners")


def moved(keys: DataFrame, before: Ring, after: Ring) -> DataFrame:
    """``key, old_owner, new_owner`` of the keys whose owner changes from one ring to the other."""
    a = before.owner(keys.select("key")).withColumnRenamed("owner", "old_owner")
    b = after.owner(a).withColumnRenamed("owner", "new_owner")
    return b.where("old_owner != new_owner")


def membership(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Nodes after a series of ``join``, ``update`` and ``leave`` events: the latest event of each node, unless it left."""
    last = events.groupBy("node_id").agg(F.max(F.struct(seq, "kind", "grpc_port", "weight")).alias("w"))
    return last.where("w.kind != 'leave'").select("node_id", "w.grpc_port", "w.weight")


def reachable(nodes: DataFrame) -> DataFrame:
    """Members that announce a port."""
    return nodes.where("grpc_port > 0")


def others(nodes: DataFrame, me: str) -> DataFrame:
    """Members besides ``me``."""
    return nodes.where(F.col("node_id").isNotNull() & (F.col("node_id") != me))


def pairs(names: list[str], seed: int | None = None, step: int = 1) -> list[tuple[str, str]]:
    """Every node with the peer that it exchanges with: drawn by ``seed``, or the one ``step`` places further. A node that is alone has none."""
    names = sorted(set(names))
    if seed is None:
        ends = [(n, names[(i + step) % len(names)]) for i, n in enumerate(names)]
    else:
        ends = [(n, min((o for o in names if o != n), key=lambda o, n=n: _hash(f"{seed}/{n}/{o}"), default=n)) for n in names]
    return [(n, o) for n, o in ends if n != o]


def pick_peer(nodes: DataFrame, me: str, seed: int) -> DataFrame:
    """The member that ``me`` exchanges with in round ``seed``: one row, none where it is alone. The same seed gives the same peer."""
    return others(nodes, me).orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(1)
