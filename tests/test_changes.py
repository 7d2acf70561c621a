"""Copy differences, newest-first resolution, the delivery store and snapshot differences against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from keyfold.operators import celldiff, delivery, newest, snapdiff
from keyfold.session import shared_path
from keyfold.streaming.merge import plain_item_hash

from .conftest import ENTRIES, LOG, rows

FIELDS = ["value", "ts", "node_id", "tombstone"]


# --- copies ---


def _diff(a, b):
    return rows(celldiff.copy_differences(a, b, "key", FIELDS))


def test_copies(entries):
    a = entries(("same", b"v", 1, "n", False), ("same", b"v", 1, "n", False), ("gone", b"v", 1, "n", False), ("f", b"", 1, None, False), ("t", None, 1, "n", True), (None, b"x", 1, "n", False))
    b = entries(("same", b"v", 1, "n", False), ("new", b"v", 1, "n", False), ("new", b"v", 1, "n", False), ("f", None, 2, "n", None), ("t", None, 1, "n", True), (None, b"y", 1, "n", False))
    assert _diff(a, b) == sorted([("gone", "only_a"), ("new", "only_b"), ("f", "value"), ("f", "ts"), ("f", "node_id"), ("f", "tombstone"), (None, "value")], key=repr)


def test_empty_copies(entries, spark):
    none, one = spark.createDataFrame([], ENTRIES), entries(("k", b"v", 1, "n", False))
    assert _diff(none, none) == []
    assert _diff(one, none) == [("k", "only_a")]
    assert _diff(none, one) == [("k", "only_b")]


def test_keys_are_bytes(entries):
    a, b = entries(("K", b"v", 1, "n", False), ("01", b"v", 1, "n", False)), entries(("k", b"v", 1, "n", False), ("1", b"v", 1, "n", False), ("1 ", b"v", 1, "n", False))
    assert {k for k, _ in _diff(a, b)} == {"K", "k", "01", "1", "1 "}


def test_several_rows_of_a_key(entries):
    a = entries(("k", b"1", 1, "n", False), ("k", b"2", 1, "n", False))
    b = entries(("k", b"2", 1, "n", False), ("k", b"3", 1, "n", False))
    assert _diff(a, b) == [("k", "value")]


def test_a_row_that_both_hold_beside_one_that_differs(entries):
    a = entries(("k", b"1", 1, "n", False), ("k", b"2", 1, "n", False), (None, b"1", 1, "n", False), (None, b"1", 2, None, False))
    b = entries(("k", b"1", 1, "n", False), (None, b"1", 1, "n", False))
    assert _diff(a, b) == sorted([("k", "value"), (None, "ts"), (None, "node_id")], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_copies_like_sets_of_cells(entries, seed):
    r = random.Random(seed)
    make = lambda: [(r.choice(["k1", "k2", "k3", "k4", "", None]), r.choice([None, b"", b"1"]), r.choice([1, 2]), r.choice([None, "n"]), r.choice([True, False, None])) for _ in range(r.choice([4, 9]))]
    a, b = make(), make()
    b += a[:2]
    want = []
    for k in {x[0] for x in a + b}:
        p, q = [x for x in a if x[0] == k], [x for x in b if x[0] == k]
        if not p or not q:
            want.append((k, "only_a" if p else "only_b"))
        else:
            want += [(k, f) for i, f in enumerate(FIELDS, 1) if {x[i] for x in p} != {x[i] for x in q}]
    assert _diff(entries(*a), entries(*b)) == sorted(want, key=repr)


def test_clashing_columns_and_long_values(spark):
    more = ENTRIES + ", side int, field string, cell binary, sides int"
    big = bytearray(b"x" * 1_000_000)
    a = spark.createDataFrame([("k", big, 1, "n", False, 1, "a", None, 3)], more)
    b = spark.createDataFrame([("k", big + b"y", 1, "n", False, 2, "b", None, 4)], more)
    assert _diff(a, b) == [("k", "value")]
    assert celldiff.difference_summary(celldiff.copy_differences(a, b, "key", FIELDS)).collect()[0][:] == ("value", 1)


def test_other_field_types(spark):
    s = "key int, x double, y array<int>, z date"
    a = spark.createDataFrame([(1, 1.5, [1, 2], None), (2, None, None, None)], s)
    b = spark.createDataFrame([(1, 1.5, [1, 3], None), (2, None, [], None)], s)
    assert rows(celldiff.copy_differences(a, b, "key", ["x", "y", "z"])) == [(1, "y"), (2, "y")]


# --- newest first ---


def _resolved(log_, **kw):
    return {r.key: (r.op, r.seq, r.ts) for r in newest.resolve(log_, **kw).collect()}


@pytest.mark.parametrize(("batches", "room"), [(1, 0), (3, 1 << 20), (4, 150), (6, 0)])
def test_newest_first_like_a_loop(log, batches, room):
    r = random.Random(batches)
    steps = [(r.choice(["set", "set", "del"]), r.choice(["hot"] * 8 + list("abcdefgh") + [None, ""]), r.choice([None, b"", b"x", b"y"]), r.randint(-5, 30), r.choice([None, "", "n1", "n2"])) for _ in range(400)]
    best: dict = {}
    for seq, (op, k, v, ts, n) in enumerate(steps, 1):
        rank = (ts, (n or "").encode(), plain_item_hash(k, v, ts, n, op == "del"), -seq)
        if k not in best or rank > best[k][0]:
            best[k] = (rank, op)
    assert _resolved(log(*steps), batches=batches, broadcast_bytes=room) == {k: (op, -x[3], x[0]) for k, (x, op) in best.items()}


def test_base_rows_stay_where_nothing_changed(log, spark):
    base = spark.createDataFrame([("a", 1, "set", bytearray(b"old"), "n"), ("z", 1, "set", bytearray(b"kept"), "n"), (None, 1, "set", None, "n")], "key string, ts long, op string, value binary, node_id string")
    got = {r.key: (r.op, r.source) for r in newest.resolve(log(("del", "a", None, 9, "n"), ("set", "b", b"1", 3, "n")), base).collect()}
    assert got == {"a": ("del", "change"), "b": ("set", "change"), "z": ("set", "base"), None: ("set", "base")}
    assert {r.key for r in newest.resolve(spark.createDataFrame([], LOG), base).collect()} == {"a", "z", None}


@pytest.mark.parametrize("room", [0, 1 << 20])
def test_late_changes_lose_to_the_base(log, spark, room):
    base = spark.createDataFrame([("a", 5, "set", bytearray(b"base"), "n"), ("b", 5, "del", None, "n"), ("c", 5, "set", bytearray(b"same"), "n"), ("d", 5, "set", None, None)], "key string, ts long, op string, value binary, node_id string")
    late = log(("set", "a", b"late", 4, "n"), ("set", "b", b"new", 6, "n"), ("set", "c", b"same", 5, "n"), ("del", "e", None, 1, "n"))
    got = {r.key: (r.op, r.value and bytes(r.value), r.ts, r.source) for r in newest.resolve(late, base, broadcast_bytes=room).collect()}
    assert got == {"a": ("set", b"base", 5, "base"), "b": ("set", b"new", 6, "change"), "c": ("set", b"same", 5, "change"), "d": ("set", None, 5, "base"), "e": ("del", None, 1, "change")}


def test_rows_without_clock_or_kind_are_left_out(log, spark):
    assert _resolved(log(("set", "a", b"1", None, "n"), ("move", "b", b"1", 1, "n"), (None, "c", b"1", 1, "n"), ("set", "d", b"1", 1, "n"))) == {"d": ("set", 4, 1)}
    assert _resolved(spark.createDataFrame([], LOG)) == {}
    assert newest.live(newest.resolve(log(("del", "a", None, 1, "n")))).count() == 0


# --- deliveries ---

T0 = datetime(2025, 3, 1)
PUSH = "delivery_id long, replica string, op string, key string, ts long, node_id string, value binary, received_at timestamp, part int, day string, id int, w string"
MSG = ["replica", "op", "key", "ts", "node_id"]


def _pushes(spark, n, seed):
    r = random.Random(seed)
    return [
        (i, r.choice("ab"), "set", r.choice(["hot"] * 3 + list("pqrs") + [None]), r.randint(1, 3), r.choice([None, "", "n"]), None if r.random() < 0.3 else bytearray(bytes([r.randint(0, 9)])), None if r.random() < 0.05 else T0 + timedelta(hours=3 * i), 5, "d", i, None)
        for i in range(1, n + 1)
    ]


def _brute_duplicates(data):
    seen, out = set(), []
    for d in sorted(data):
        out += [d[0]] if d[1:6] in seen else []
        seen.add(d[1:6])
    return out


@pytest.mark.parametrize("order", ["forward", "backward", "twice"])
def test_batches_in_any_order_keep_one_copy(spark, order):
    data = _pushes(spark, 120, 4)
    parts = [data[i : i + 40] for i in range(0, 120, 40)]
    parts = {"forward": parts, "backward": parts[::-1], "twice": [*parts, parts[1]]}[order]
    store = delivery.DeliveryStore(spark, shared_path(spark, "store"), MSG, "delivery_id", "received_at")
    for p in parts:
        store.merge(spark.createDataFrame(p, PUSH))
    want = _brute_duplicates(data)
    if order == "forward":
        store.compact()
        assert all(len(dirs) == 1 for dirs in store._manifest()[1]["parts"].values())
        store.merge(spark.createDataFrame(parts[0], PUSH))
    assert sorted(r[0] for r in store.duplicates().collect()) == want
    assert sorted(r.delivery_id for r in store.current().collect()) == sorted({d[0] for d in data} - set(want))
    assert {(r.delivery_id, r.part, r.day, r.id, r.w) for r in store.current().collect()} <= {(d[0], 5, "d", d[0], None) for d in data}


def test_only_partitions_that_lose_a_winner_are_rewritten(spark):
    store = delivery.DeliveryStore(spark, shared_path(spark, "store"), MSG, "delivery_id", "received_at", buckets=1)
    day = lambda n: T0 + timedelta(days=n)
    make = lambda *r: spark.createDataFrame([(i, "a", "set", k, 1, "n", None, t, 1, "x", 1, "y") for i, k, t in r], PUSH)
    store.merge(make((11, "k1", day(0)), (12, "k2", day(1)), (13, "k3", day(2))))
    store.merge(make((14, "k2", day(5)), (15, "k9", day(5)), (16, "k9", day(5)), (16, "k9", day(5))))
    assert store.affected() == ["2025-03-02.0"] and store.rewritten() == []
    assert sorted(r[0] for r in store.duplicates().collect()) == [14, 16]
    store.merge(make((1, "k3", day(5)), (2, "k1", day(0)), (17, "k2", day(1)), (18, "k8", day(1)), (18, "k8", day(1))))
    assert store.affected() == ["2025-03-01.0", "2025-03-02.0", "2025-03-03.0"] and store.rewritten() == ["2025-03-01.0", "2025-03-03.0"]
    assert sorted(r[0] for r in store.duplicates().collect()) == [11, 13, 14, 16, 17]
    assert rows(store.current().select("key", "delivery_id")) == [("k1", 2), ("k2", 12), ("k3", 1), ("k8", 18), ("k9", 15)]


@pytest.mark.parametrize("limits", [(0, 1), (10**6, 16)])
def test_joins_by_shuffle_and_by_broadcast_agree(spark, limits, monkeypatch):
    monkeypatch.setattr(delivery, "BROADCAST_IDS", limits[0])
    monkeypatch.setattr(delivery, "INDEX_FOLDERS", limits[1])
    data = _pushes(spark, 200, 8)
    random.Random(1).shuffle(data)
    store = delivery.DeliveryStore(spark, shared_path(spark, "store"), MSG, "delivery_id", "received_at", buckets=3)
    for i in range(0, 200, 50):
        store.merge(spark.createDataFrame(data[i : i + 50], PUSH))
    assert sorted(r[0] for r in store.duplicates().collect()) == _brute_duplicates(data)
    assert store.current().count() == 200 - len(_brute_duplicates(data))
    assert len(store._manifest()[1]["index"]) <= limits[1]


def test_a_delivery_without_an_order_is_an_error(spark):
    store = delivery.DeliveryStore(spark, shared_path(spark, "store"), MSG, "delivery_id", "received_at")
    with pytest.raises(Exception, match="has no delivery_id"):
        store.merge(spark.createDataFrame([(None, *_pushes(spark, 1, 1)[0][1:])], PUSH))


def test_two_writers_can_not_commit_one_version(spark):
    path = shared_path(spark, "store")
    store = delivery.DeliveryStore(spark, path, MSG, "delivery_id", "received_at")
    other = delivery.DeliveryStore(spark, path, MSG, "delivery_id", "received_at")
    batch = spark.createDataFrame(_pushes(spark, 1, 1), PUSH)
    state = other._manifest()
    store.merge(batch)
    other._manifest = lambda: state
    with pytest.raises(RuntimeError):
        other.merge(batch)


def test_empty_batches(spark):
    store = delivery.DeliveryStore(spark, shared_path(spark, "store"), MSG, "delivery_id", "received_at")
    assert store.current() is None and store.duplicates() is None
    none = spark.createDataFrame([], PUSH)
    store.merge(none)
    store.merge(none)
    assert store.current().count() == store.duplicates().count() == 0
    assert delivery.in_batches(none, "delivery_id", 4, shared_path(spark, "in")) == []
    data = _pushes(spark, 50, 3)
    parts = delivery.in_batches(spark.createDataFrame(data, PUSH), "delivery_id", 4, shared_path(spark, "in"))
    ids = [sorted(r.delivery_id for r in p.collect()) for p in parts]
    assert len(ids) == 4 and sum(ids, []) == list(range(1, 51))


# --- snapshots ---

SNAP = "snapshot_id int, key string, value binary, ts long, tombstone boolean, node_id string, ord int, bucket int, k1 long"


def _snaps(spark, data):
    return spark.createDataFrame([(s, k, None if v is None else bytearray(v), t, d, "n", 1, 2, 3) for s, k, v, t, d in data], SNAP)


def _brute_snapshots(data):
    ids = sorted({r[0] for r in data})
    live = {}
    for s in ids:
        best: dict = {}
        for i, k, v, t, d in data:
            if i == s:
                rank = (t is not None, t or 0, bool(d))
                if k not in best or rank > best[k][0]:
                    best[k] = (rank, v, t, d)
        live[s] = {k: (v, t) for k, (_, v, t, d) in best.items() if not d}
    out = []
    for a, b in zip(ids, ids[1:], strict=False):
        out += [(b, k, "added") for k in live[b].keys() - live[a].keys()] + [(b, k, "removed") for k in live[a].keys() - live[b].keys()]
        out += [(b, k, "changed") for k in live[a].keys() & live[b].keys() if live[a][k] != live[b][k]]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bucket", "cells"), [(1, 0.0), (150, 0.01), (65_536, 0.375)])
def test_snapshots_like_sets(spark, bucket, cells):
    r = random.Random(bucket)
    data = []
    for s in (3, 7, 8, 20):
        for k in [f"k{i}" for i in range(150)] + [None, ""]:
            if r.random() < 0.9:
                t = r.choice([1, 2, 3, None])
                v = f"{k}{t}".encode() if r.random() < 0.8 else r.choice([None, b""])
                data += [(s, k, v, t, r.random() < 0.1)] * r.choice([1, 1, 2])
                if t and r.random() < 0.2:
                    data.append((s, k, b"older", t - 1, False))
    got = snapdiff.snapshot_changes(_snaps(spark, data), bucket_rows=bucket, first_cells=cells)
    assert rows(got) == _brute_snapshots(data)


def test_one_or_no_snapshot(spark):
    assert snapdiff.snapshot_changes(_snaps(spark, [(1, "a", b"", 1, False)])).count() == 0
    assert snapdiff.snapshot_changes(spark.createDataFrame([], SNAP)).columns == ["snapshot_id", "key", "kind"]


def test_tombstones_and_equal_clocks(spark):
    data = [(1, "a", b"x", 1, False), (1, "a", b"x", 1, True), (1, "b", b"x", 1, True), (2, "a", b"x", 1, False), (2, "b", b"x", 2, False), (2, "c", b"x", 2, None)]
    assert rows(snapdiff.snapshot_changes(_snaps(spark, data))) == [(2, "a", "added"), (2, "b", "added"), (2, "c", "added")]


def test_peel_gives_up_on_a_full_table_and_finds_all_in_a_roomy_one():
    rng = np.random.default_rng(1)
    n = 60
    e = {c: rng.integers(-(1 << 62), 1 << 62, n) for c in ("k1", "k2", "v")}
    e["chk"] = snapdiff.check(*e.values())
    half = [{c: x[i::2] for c, x in e.items()} for i in (0, 1)]
    for m, ok in ((10, False), (60, True)):
        a, b = snapdiff.Table(m), snapdiff.Table(m)
        a.put(half[0])
        b.put(half[1])
        got = a.minus(b).peel()
        assert (got is not None) == ok
        if ok:
            assert sorted(zip(got["k1"], got["sign"], strict=True)) == sorted((k, -1 if i % 2 else 1) for i, k in enumerate(e["k1"]))
    t = snapdiff.Table(60)
    t.put(e)
    t.digest ^= 1
    assert t.peel() is None  # what was peeled isn't what the digest says
    got = snapdiff.subtract(half[0], half[1], 0.0)
    assert len(got["k1"]) == n


def test_buckets_end_between_keys_whatever_the_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    data = [(s, f"k{i}", str(i * (s == 2 and i % 7 == 0)).encode(), 1, False) for s in (1, 2, 5) for i in range(60)] + [(1, "hot", b"x", t, False) for t in range(100)] + [(2, "hot", b"x", 99, False)]
    try:
        for n in (1, 7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert rows(snapdiff.snapshot_changes(_snaps(spark, data), bucket_rows=20)) == _brute_snapshots(data)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_hot_key_of_copies(log):
    steps = [("set", "hot", b"same", 5, "n")] * 500 + [("set", "other", b"x", 1, "n")]
    assert _resolved(log(*steps)) == {"hot": ("set", 1, 5), "other": ("set", 501, 1)}
