"""Stores that evict, are built from settings and keep their digests, and clusters of them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from keyfold.cluster import Cluster
from keyfold.config import Cluster as Settings
from keyfold.config import StoreConfig
from keyfold.operators import digest, evict, fold
from keyfold.operators.ring import Ring, pairs
from keyfold.session import shared_path
from keyfold.sources import files
from keyfold.store import KVStore

from .conftest import rows


def test_a_store_evicts_what_is_pushed_out_or_runs_out(spark):
    kv = KVStore(spark, shared_path(spark, "kv"), lru=evict.Lru(2, 600_000, 1))
    kv.set_many({"a": b"1", "b": b"2"})
    assert kv.get("a") == b"1"  # seen again, so b is older
    kv.set("c", b"3")
    now = max(t for _, t, _ in kv._seen)
    assert kv.evict(now) == 2 and kv.occupancy() == 1.0
    assert [kv.exists(k) for k in "abc"] == [True, False, True]
    assert {r.key for r in kv.store.state().collect()} == {"a", "c"}  # b is gone, not a tombstone
    assert kv.evict(now + 700_000) == 0 and kv.occupancy() == 0.0
    assert {(r.key, r.tombstone) for r in kv.store.state().collect()} == {("a", True), ("c", True)}
    kv.set("a", b"4")
    assert kv.get("a") == b"4"
    kv.delete("a")
    assert kv.evict(now) == 0
    with pytest.raises(ValueError):
        KVStore(spark, kv.store.path).evict()


def test_what_the_cache_held_is_carried_over(spark):
    kv = KVStore(spark, shared_path(spark, "kv"), lru=evict.Lru(3, 0, 1), snapshots=False)
    lg = spark.createDataFrame([(i, "set", k, bytearray(b"v"), i, "n") for i, k in enumerate("abcd", 1)], "seq long, op string, key string, value binary, ts long, node_id string")
    kv.store.append(lg)
    acc = lambda *x: kv.take_accesses(spark.createDataFrame([(s, k, s, w) for s, k, w in x], "seq long, key string, at long, kind string"))
    acc((1, "a", "seen"), (2, "b", "seen"), (3, "c", "seen"))
    assert kv.evict() == 3
    acc((4, "a", "seen"), (5, "d", "seen"))
    assert kv.evict() == 3
    assert {r.key for r in fold.live(kv.store.state()).collect()} == {"a", "c", "d"}
    assert {(r.key, r.seq) for r in kv._held()[2].collect()} == {("a", 4), ("c", 3), ("d", 5)}


def test_a_store_from_settings(spark, tmp_path):
    c = StoreConfig.default().set(wal_path=str(tmp_path / "wal"), insecure=True, node_id="me")
    kv = KVStore.open(spark, c)
    assert kv.lru == evict.Lru() and kv.node_id == "me"
    kv.set("k", b"v")
    kv.close()
    assert KVStore.open(spark, c).get("k") == b"v" and kv.store.has(1)
    v = KVStore.open(spark, c.volatile())
    v.set("k", b"w")
    assert v.get("k") == b"w"
    path = v.store.path
    v.close()
    assert not files.exists(spark, path)
    with pytest.raises(ValueError):
        KVStore.open(spark, c.set(wal_segments=0))


def test_a_stream_into_a_store(spark, log, tmp_path):
    from keyfold.streaming import merge

    lg = log(*(("set", f"k{i}", b"1", i, "n") for i in range(6)))
    lg.repartition(3).write.parquet(str(tmp_path / "in"))
    c = StoreConfig.default().set(wal_path=str(tmp_path / "wal"), insecure=True, wal_interval=10, snapshot_interval=20)
    kv = KVStore.open(spark, c)
    kv.follow(merge.log_feed(spark, str(tmp_path / "in"), lg.schema, 1), str(tmp_path / "cp"), c).awaitTermination(60)
    assert kv.store.state().count() == 6 and kv.store.has(1)


def test_digests_after_a_snapshot_and_a_tail(spark):
    kv = KVStore(spark, shared_path(spark, "kv"))
    kv.set_many({"a": b"1", "b": b"2"})
    whole = lambda: digest.root_digest(kv.hashed()).first()["digest"]
    assert kv.root() == whole()
    kv.snapshot()
    assert kv.root() == whole()
    kv.set("a", b"9")
    kv.delete("b")
    kv.set("c", b"1")
    assert kv.root() == whole()


RING = Ring({"n1": 64, "n2": 64, "n3": 64, "n4": 64})


def _log(spark, *writes):
    return spark.createDataFrame([(i, op, k, None if v is None else bytearray(v), i, "n") for i, (op, k, v) in enumerate(writes, 1)], "seq long, op string, key string, value binary, ts long, node_id string")


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_writes_reads_and_deletes_of_a_cluster(spark, mode):
    c = Cluster(spark, shared_path(spark, "c"), RING, Settings(replication_factor=3, failure_mode=mode))
    writes = [("set", f"k{i}", str(i).encode()) for i in range(20)]
    down = F.col("replica") == "n2"
    got = {r.write_id: r.ok for r in c.write(_log(spark, *writes), down).collect()}
    on2 = {i for i in range(1, 21) if "n2" in RING.owners(f"k{i - 1}", 3)}
    assert got == {i: mode == "lenient" or i not in on2 for i in range(1, 21)} and on2
    keys = spark.createDataFrame([(f"k{i}",) for i in range(21)], "key string")
    answers = {r.key: (r.value and bytes(r.value), r.replica) for r in c.read(keys).collect()}
    for i in range(20):
        assert answers[f"k{i}"] == (str(i).encode(), next(o for o in RING.owners(f"k{i}", 3) if o != "n2"))
    assert answers["k20"] == (None, None)
    assert {r.key for r in c.existed(keys).where("existed").collect()} == {f"k{i}" for i in range(20)}
    c.write(_log(spark, *writes, ("del", "k3", None), ("del", "zz", None)).where("seq > 20"))
    assert not c.existed(keys.where("key = 'k3'")).first()["existed"]
    assert c.states().where("key = 'zz' and tombstone").count() == 3


def test_rounds_of_exchange_bring_replicas_together(spark):
    c = Cluster(spark, shared_path(spark, "c"), RING, Settings(replication_factor=3))
    c.write(_log(spark, *(("set", f"k{i}", b"v") for i in range(30))), F.col("replica") == "n1")
    want = sorted((o, f"k{i}") for i in range(30) for o in RING.owners(f"k{i}", 3))
    for step in (1, 2, 3):
        c.round(step=step)
    assert rows(c.states().select("replica", "key")) == want
    assert c.round() == 0 and c.round(seed=4) == 0
    c.snapshot()
    assert rows(c.states().select("replica", "key")) == want
    alone = Cluster(spark, shared_path(spark, "c"), Ring({"a": 1}), Settings(single_node=True))
    assert alone.write(_log(spark, ("set", "k", b"1"))).first()["ok"] and alone.round() == 0


def test_peers_of_a_round():
    assert pairs(["b", "a", "c"]) == [("a", "b"), ("b", "c"), ("c", "a")] and pairs(["a"]) == pairs(["a"], 3) == []
    drawn = [dict(pairs(["a", "b", "c"], s)) for s in range(20)]
    assert all(n != o for d in drawn for n, o in d.items()) and {d["a"] for d in drawn} == {"b", "c"}


def test_control_files_need_a_file_system_that_refuses_to_overwrite(spark, monkeypatch):
    path = f"{shared_path(spark, 'f')}/x"
    assert files.create_once(spark, path, "1") and not files.create_once(spark, path, "2")
    monkeypatch.setattr(files, "ATOMIC", ("hdfs",))
    with pytest.raises(ValueError, match="one writer alone"):
        files.create_once(spark, f"{os.path.dirname(path)}/y", "1")
