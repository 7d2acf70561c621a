"""Ring, replication, digests and exchange."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keyfold.operators import digest, fold, replicate
from keyfold.operators.ring import Ring, membership, moved, reachable

from .conftest import rows

KEYS = [f"key-{i}" for i in range(300)] + ["", "é"]


@pytest.fixture
def keys(spark):
    return spark.createDataFrame([(k, i) for i, k in enumerate(KEYS)] + [(None, -1)], "key string, owner_no int")


@pytest.mark.parametrize("weights", [{"n1": 128, "n2": 64, "n3": 16}, {"only": 1}, {"a": 1, "b": 2}, {f"n{i}": 128 for i in range(40)}])
def test_lookup_like_a_search(keys, weights):
    ring = Ring(weights)
    for rf in (1, 3):
        got = {r.key: r.owners for r in ring.place(keys, rf).collect()}
        assert got.pop(None) is None
        assert got == {k: ring.owners(k, rf) for k in KEYS}
        assert all(len(o) == len(set(o)) == min(rf, len(weights)) for o in got.values())


def test_weights(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", -1), ("c", None), ("d", 5), (None, 9), ("d", 7)], "node_id string, weight int")
    ring = Ring.of(nodes)
    assert ring.weights == {"a": 0, "b": 128, "c": 128, "d": 7}
    assert {n for _, n, _ in ring.vnodes} == {"b", "c", "d"}
    assert ring.reweighted("zz", 5) is ring
    assert ring.added({"d": 100, "e": 1}).weights["d"] == 7
    assert ring.vnode_table(spark).count() == 263


def test_empty_ring_and_no_replicas(keys):
    assert {r.owner for r in Ring({}).owner(keys).collect()} == {""}
    assert {tuple(r.owners) for r in Ring({}).place(keys, 3).where("key is not null").collect()} == {()}
    assert {tuple(r.owners) for r in Ring({"a": 1}).place(keys, 0).where("key is not null").collect()} == {()}
    assert Ring({"a": 0}).owners("k", 1) == [] and Ring({"a": 1}).owners("k", -1) == []
    with pytest.raises(ValueError):
        Ring({"a": 2_000_000})


def test_keys_move_only_from_the_node_that_leaves(keys):
    ring = Ring({f"n{i}": 128 for i in range(5)})
    gone = moved(keys, ring, ring.removed("n2")).collect()
    assert gone and {r.old_owner for r in gone} == {"n2"}
    shed = ring.reweighted("n2", 0)
    assert {(r.key, r.new_owner) for r in moved(keys, ring, shed).collect()} == {(r.key, r.new_owner) for r in gone}


def test_membership(spark):
    e = spark.createDataFrame([(1, "a", "join", 1, 128), (2, "b", "join", 0, 128), (3, "a", "update", 7, 16), (4, "c", "join", 2, 1), (5, "c", "leave", None, None)], "seq long, node_id string, kind string, grpc_port int, weight int")
    assert rows(membership(e)) == [("a", 7, 16), ("b", 0, 128)]
    assert rows(reachable(membership(e))) == [("a", 7, 16)]


def test_outcomes(spark):
    table = {1: (0, 0), 2: (1, 0), 3: (0, 1), 4: (1, 1)}
    a = spark.createDataFrame([(w, f"r{i}", bool(x)) for w, fs in table.items() for i, x in enumerate(fs)] + [(5, "r0", None), (6, "r0", False)], "write_id int, replica string, failed boolean")
    w = spark.createDataFrame([(i,) for i in range(1, 8)], "write_id int")
    ok = lambda mode: {r.write_id: r.ok for r in replicate.outcome(a, mode, w).collect()}
    assert ok("lenient") == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False}
    assert ok("strict") == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}
    with pytest.raises(ValueError):
        replicate.outcome(a, "loose")


def test_reads_pass_over_owners_without_the_key(spark):
    ring = Ring({"a": 64, "b": 64, "c": 64})
    keys = ["k1", "k2", "k3", "k4"]
    o = {k: ring.owners(k, 3) for k in keys}
    held = [(o["k1"][0], "k1", b"x", False), (o["k1"][1], "k1", b"y", False), (o["k2"][0], "k2", None, True), (o["k2"][2], "k2", b"", False), (o["k3"][1], "k3", None, True)]
    states = spark.createDataFrame([(r, k, None if v is None else bytearray(v), t) for r, k, v, t in held], "replica string, key string, value binary, tombstone boolean")
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: (None if r.value is None else bytes(r.value), r.replica) for r in replicate.first_owner_read(df, states, ring, 3).collect()}
    assert got == {"k1": (b"x", o["k1"][0]), "k2": (b"", o["k2"][2]), "k3": (None, None), "k4": (None, None)}
    own = {r.key: r.replica for r in replicate.first_owner_read(df, states, ring, 3, requester=o["k2"][0]).collect()}
    assert own["k2"] is None  # its own tombstone is final
    assert {r.key: r.existed for r in replicate.exists_anywhere(df, states, ring, 3).collect()} == {"k1": True, "k2": True, "k3": False, "k4": False}
    assert replicate.fan_out(df, ring, 0).count() == 4


def _h(df):
    return fold.hashed(df)


def test_empty_state_digests(spark):
    none = _h(digest.empty_entries(spark))
    assert digest.root_digest(none).first().digest == 0
    assert {f"{r.digest % (1 << 64):016x}" for r in digest.sub_digests(none).collect()} == {"5692161d100b05e5"}
    assert digest.shard_digests(none).count() == 128
    assert digest.mismatched(none, none).count() == 0


def test_digests_follow_the_items(entries):
    a = _h(entries(("x", b"1", 1, "n", False), ("y", b"2", 1, "n", False)))
    b = _h(entries(("y", b"2", 1, "n", False), ("x", b"1", 1, "n", False)))
    c = _h(entries(("x", b"1", 1, "n", False), ("y", b"2", 2, "n", False)))
    d = _h(entries(("x", b"1", 1, "n", False), ("y", None, 1, "n", True)))
    roots = [digest.root_digest(x).first().digest for x in (a, b, c, d)]
    assert roots[0] == roots[1] and len(set(roots)) == 3
    assert digest.mismatched(a, b).count() == 0
    assert digest.mismatched(a, c).collect() == [(r.shard, r.sub) for r in a.where("key = 'y'").collect()]


def test_incremental_digests(entries):
    old, new = entries(("x", b"1", 1, "n", False), ("y", b"2", 1, "n", False)), entries(("x", b"9", 5, "n", False), ("z", b"2", 1, "n", False))
    whole = lambda e: {(r.shard, r.sub): (r.x, r.cnt) for r in digest.sums(_h(e)).collect()}
    state = digest.sums(_h(old))
    after = digest.update_digests(state, _h(old.where("key = 'x'")), _h(new))
    want = whole(old.where("key = 'y'").unionByName(new))
    assert {(r.shard, r.sub): (r.x, r.cnt) for r in after.where("cnt > 0").collect()} == want


def test_one_round_each_way_converges(entries):
    r = random.Random(9)
    make = lambda seed: entries(*((f"k{i}", bytes([r.randint(0, 3)]), r.randint(1, 3), r.choice(["n1", "n2"]), r.random() < 0.2) for i in range(80) if r.random() < 0.8))  # noqa: E731, ARG005
    a, b = _h(make(1)), _h(make(2))
    a2 = digest.merge(a, digest.pull(a, b))
    b2 = digest.merge(b, digest.pull(b, a))
    assert rows(a2) == rows(b2)
    assert digest.pull(_h(a2), _h(b2)).count() == 0
    ring = Ring({"n1": 64, "n2": 64})
    part = digest.pull(a, b, "n1", ring, 1)
    assert {x.key for x in part.collect()} == {x.key for x in digest.pull(a, b).collect() if ring.owners(x.key, 1) == ["n1"]}


def test_scan_of_a_shard_that_is_not_there(entries):
    h = _h(entries(("x", b"1", 1, "n", False)))
    assert fold.scan_buckets(h, 500, list(range(64))).count() == 0
    assert h.select(F.col("shard").between(0, 127) & F.col("sub").between(0, 63)).first()[0]


def test_requests_and_answers(entries):
    a = _h(entries(*((f"k{i}", b"1", 1, "n", False) for i in range(60))))
    b = _h(entries(*((f"k{i}", b"1", 1 + (i == 7), "n", False) for i in range(60))))
    ask = digest.request(a)
    assert ask.count() == 1 + 128 + 8192
    assert {r.key for r in digest.answer(ask, b).collect()} >= {"k7"}
    assert rows(digest.answer(ask, b)) == rows(digest.pull(a, b))
    assert digest.answer(digest.request(b), b).count() == 0
    place = b.where("key = 'k7'").first()
    whole = digest.answer(ask.where(~((F.col("level") == "sub") & (F.col("shard") == place.shard) & (F.col("sub") == (place["sub"] + 1) % 64))), b)
    assert rows(whole) == rows(b.where(F.col("shard") == place.shard).select(*fold.ENTRY))
    assert digest.answer(ask.limit(0), b).count() == 60


def test_peers(spark):
    from keyfold.operators.ring import others, pick_peer

    nodes = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "node_id string")
    assert rows(others(nodes, "a")) == [("b",), ("c",)]
    assert {pick_peer(nodes, "a", s).first().node_id for s in range(12)} == {"b", "c"}
    assert pick_peer(nodes, "a", 3).collect() == pick_peer(nodes, "a", 3).collect()
    assert pick_peer(nodes.where("node_id = 'a'"), "a", 1).count() == 0


def test_physical_removal(entries, spark):
    e = entries(("a", b"1", 1, "n", False), (None, b"2", 1, "n", False), ("", b"3", 1, "n", False))
    out = spark.createDataFrame([("a",), ("a",), (None,)], "key string")
    assert rows(fold.remove(e, out)) == [("", b"3", 1, "n", False)]
