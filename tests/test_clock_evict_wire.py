"""Clock, eviction, wire protocol, log files, stores, streams, settings."""

from __future__ import annotations

import os
import random
from collections import OrderedDict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.__main__ import main
from keyfold.config import Cluster, StoreConfig
from keyfold.functions import clock, resp
from keyfold.operators import evict, fold
from keyfold.operators.fold import ENTRY
from keyfold.plans import state
from keyfold.session import shared_path
from keyfold.sources import segments, wire
from keyfold.sources.snapshots import StateStore
from keyfold.store import KVStore
from keyfold.streaming import gossip, merge

from .conftest import LOG, rows

DIR = "/root/testdata/sf0.001"

# --- clock ---


def test_pack_and_back(spark):
    df = spark.createDataFrame([(5, 7), (-3, 70000), (1 << 60, 1)], "ms long, n int").select(clock.pack(F.col("ms"), F.col("n")).alias("t"))
    got = [(r[0], r[1]) for r in df.select(clock.ms_of(F.col("t")), clock.logical_of(F.col("t"))).collect()]
    assert got == [(5, 7), (0, 70000 & 0xFFFF), (clock.MAX_MS, 1)]


def test_now_like_a_loop(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "b", None]), i, r.choice([None, -5, 3, 10, 10, 11, 50])) for i in range(200)]
    state, want = {}, []
    for n, _, ms in data:
        state[n] = clock.after_now(state.get(n, -1) if n in state else -1, ms or 0)
        want.append(state[n])
    got = clock.now_sequence(spark.createDataFrame(data, "node_id string, seq long, ms long")).orderBy("seq").collect()
    assert [x.ts for x in got] == want


def test_ceiling(spark):
    got = clock.now_sequence(spark.createDataFrame([("a", 1, (1 << 62)), ("a", 2, 5)], "node_id string, seq long, ms long")).collect()
    assert {x.ts for x in got} == {clock.MAX_TS}
    assert clock.after_now(clock.MAX_TS, 5) == clock.MAX_TS == clock.after_update(clock.MAX_TS, 9, 5)


def test_remote_clocks():
    now, s = 1000, 1000 << 16
    assert clock.after_update(s, (now + 2000) << 16, now) == ((now + 2000) << 16) + 1
    assert clock.after_update(s, (now + 3_600_000) << 16, now) == s
    assert clock.after_update(s, -1, now) == clock.after_update(s, None, now) == s
    assert clock.after_update(s, (500 << 16) + 9, now) == s + 1
    assert clock.after_update(s + 4, s + 9, now) == s + 10
    assert clock.after_update(s, 5, now + 1) == (now + 1) << 16


def test_clock_states_like_a_loop(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "b"]), i, 1000 + i // 3, None if r.random() < 0.4 else ((1000 + r.randint(-5, 6000)) << 16) + r.randint(0, 5)) for i in range(200)]
    state, want = {}, []
    for n, i, ms, remote in data:
        s = state.get(n, 0)
        state[n] = clock.after_now(s, ms) if remote is None else clock.after_update(s, remote, ms)
        want.append((n, i, state[n]))
    assert rows(clock.run_clock(spark.createDataFrame(data, "node_id string, seq long, ms long, remote long"))) == sorted(want, key=repr)
    df = spark.createDataFrame([(-1, 5), (6000 << 16, 1000), (6001 << 16, 1000), (None, 1)], "t long, now long")
    assert [x[0] for x in df.select(clock.believed(F.col("t"), F.col("now"))).collect()] == [False, True, False, False]


# --- eviction ---


def _folded(lg, family="xxh64"):
    return fold.fold(fold.as_entries(lg).select(*ENTRY), family)


def _acc(spark, *a):
    return spark.createDataFrame([(i, k, t, kind) for i, (k, t, kind) in enumerate(a, 1)], "seq long, key string, at long, kind string")


def test_limits():
    assert evict.Lru(10, 0, 16).shards == 10 and evict.Lru(500, 0, 16).per_shard == 31
    for bad in ({"capacity": 0}, {"shards": 0}):
        with pytest.raises(ValueError):
            evict.Lru(**bad)


def test_the_oldest_leaves_a_full_shard(spark):
    a = _acc(spark, *((f"k{i}", i, "seen") for i in range(1, 6)))
    lru = evict.Lru(4, 0, 1)
    assert rows(evict.evicted(a, lru)) == [("k1",)] and rows(evict.events(a, lru)) == [(5, 0, "k1", "capacity")]


def test_age_slides(spark):
    lru = evict.Lru(10, 200, 1)
    a = _acc(spark, ("k", 0, "seen"), ("k", 120, "seen"))
    assert evict.expired(a, 240, lru).count() == 0 and rows(evict.expired(a, 440, lru)) == [("k", 120)]
    assert evict.expired(a, 10**9, evict.Lru(10, 0, 1)).count() == 0
    assert rows(evict.lifetimes(a, 200).select("accesses")) == [(2,)]


@pytest.mark.parametrize("ttl", [0, 15])
def test_eviction_events_like_a_loop(spark, ttl):
    r = random.Random(ttl)
    lru = evict.Lru(12, ttl, 3)
    data = [(f"k{r.randint(0, 30)}", i // 2, "delete" if r.random() < 0.1 else "seen") for i in range(300)]
    a = _acc(spark, *data)
    shard = {x.key: x.s for x in a.select("key", evict.lru_shard(F.col("key"), lru).alias("s")).distinct().collect()}
    caches: dict = {s: OrderedDict() for s in range(3)}
    want = []
    for seq, (k, t, kind) in enumerate(data, 1):
        c = caches[shard[k]]
        for old in [o for o, seen in c.items() if ttl and seen + ttl <= t]:
            del c[old]
            want.append((seq, shard[k], old, "ttl"))
        if kind == "delete":
            c.pop(k, None)
            continue
        if k not in c and len(c) >= lru.per_shard:
            want.append((seq, shard[k], c.popitem(last=False)[0], "capacity"))
        c.pop(k, None)
        c[k] = t
    assert rows(evict.events(a, lru)) == sorted(want, key=repr)
    if not ttl:
        seen_only = _acc(spark, *((k, t, "seen") for k, t, _ in data))
        gone = {x.key for x in evict.evicted(seen_only, lru).collect()}
        assert {x.key for x in evict.resident(seen_only, lru).collect()} == {k for k, *_ in data} - gone


def _cache_in_the_end(data, lru, shard):
    """Keys that a cache of ``(key, at, kind)`` holds in the end, and those that it evicted last."""
    caches, gone = {s: OrderedDict() for s in range(lru.shards)}, set()
    for k, t, kind in [*data, (None, max(t for _, t, _ in data), "end")]:
        for c in caches.values():  # time is the same for all shards
            for old in [o for o, seen in c.items() if lru.ttl_ms and seen + lru.ttl_ms <= t]:
                del c[old]
                gone.add(old)
        if kind == "end":
            break
        c = caches[shard[k]]
        if kind == "delete":
            c.pop(k, None)
            continue
        if k not in c and len(c) >= lru.per_shard:
            gone.add(c.popitem(last=False)[0])
        gone.discard(k)
        c.pop(k, None)
        c[k] = t
    return {(k, s, t) for s, c in caches.items() for k, t in c.items()}, gone


@pytest.mark.parametrize(("ttl", "deletes"), [(0, 0.2), (15, 0.2), (15, 0.0), (0, 0.0)])
def test_residents_after_deletes_and_ages_like_a_loop(spark, ttl, deletes):
    r = random.Random(ttl + 1)
    lru = evict.Lru(24, ttl, 3)
    data = [(f"k{r.randint(0, 30)}", i // 2, "delete" if r.random() < deletes else "seen") for i in range(300)]
    a = _acc(spark, *data)
    shard = {x.key: x.s for x in a.select("key", evict.lru_shard(F.col("key"), lru).alias("s")).distinct().collect()}
    held, gone = _cache_in_the_end(data, lru, shard)
    assert {tuple(x) for x in evict.resident(a, lru).collect()} == held
    assert {x.key for x in evict.evicted(a, lru).collect()} == gone


def test_room_of_a_delete_brings_no_key_back(spark):
    lru = evict.Lru(2, 0, 1)
    a = _acc(spark, ("a", 1, "seen"), ("b", 2, "seen"), ("c", 3, "seen"), ("c", 4, "delete"))
    assert rows(evict.resident(a, lru)) == [("b", 0, 2)] and rows(evict.evicted(a, lru)) == [("a",)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_held_keys_of_the_queries_like_a_loop(spark):
    a = state.accesses_of(spark, DIR)
    found = a.select("key", "at", "kind", evict.lru_shard(F.col("key"), state.LRU, state.FAMILY).alias("s")).orderBy("seq").collect()
    held, gone = _cache_in_the_end([x[:3] for x in found], state.LRU, {x.key: x.s for x in found})
    assert {tuple(x) for x in state.lru_held(spark, DIR).collect()} == held
    assert {x.key for x in state.lru_lost(spark, DIR).collect()} == gone
    assert state.occupancy_held(spark, DIR).first()["cached"] == len(held)


def test_what_eviction_leaves(entries):
    e = entries(("a", b"1", 5, "n", False), ("b", b"2", 5, "n", False))
    out = e.where("key = 'a'").select("key")
    assert rows(evict.tombstones(e, out, "capacity", 9, "me")) == [("b", b"2", 5, "n", False)]
    assert rows(evict.tombstones(e, out, "ttl", 1, "me")) == [("a", None, 1, "me", True), ("b", b"2", 5, "n", False)]


def test_jitter_spreads_what_runs_out_together(spark):
    plain, jitter = evict.Lru(100, 1000, 1), evict.Lru(100, 1000, 1, jitter_seed=3)
    a = _acc(spark, *((f"k{i}", 0, "seen") for i in range(40)))
    left = lambda lru, now: {x.key for x in evict.fates(a, lru, now_ms=now).where("reason = 'resident'").collect()}
    assert len(left(plain, 999)) == 40 and not left(plain, 1000)
    assert len(left(jitter, 999)) == 40 and 0 < len(left(jitter, 1050)) < 40 and not left(jitter, 1100)
    assert left(jitter, 1050) == left(jitter, 1050)


def test_a_full_queue_publishes_a_share(spark):
    a = _acc(spark, *((f"k{i}", i, "seen") for i in range(400)), *((f"k{i}", i, "delete") for i in range(20)))
    n = {f: evict.published(a, f).groupBy("kind").count().rdd.collectAsMap() for f in (0.0, 0.03, 0.9)}
    assert all(x["delete"] == 20 for x in n.values())
    assert 150 < n[0.0]["seen"] < 250 and 60 < n[0.03]["seen"] < 140 and "seen" not in n[0.9]


def test_fullness(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.85), ("a", 3, 0.89), ("a", 4, 0.9), ("a", 5, 0.1)], "node_id string, seq long, occupancy double")
    assert rows(evict.weight_changes(df)) == [("a", 2, 64), ("a", 4, 16), ("a", 5, 128)]
    f = spark.createDataFrame([(0.0,), (0.03,), (0.15,), (0.75,), (0.8,)], "f double")
    assert [r[0] for r in f.select(evict.sampled_share(F.col("f"))).collect()] == [1 / 2, 1 / 4, 1 / 16, 1 / 1024, 0.0]
    lru = evict.Lru(4, 0, 1)
    assert evict.occupancy(evict.resident(_acc(spark, ("a", 1, "seen"), ("b", 1, "seen")), lru), lru).first()[:] == (2, 4, 0.5)


# --- wire protocol ---

WHOLE = b"*3\r\n$3\r\nSET\r\n$2\r\nk1\r\n$5\r\nvalue\r\n"


def _damaged() -> list[bytes]:
    """The frame cut short anywhere, with a wrong mark, and with lengths and counts that aren't true or no numbers."""
    out = [WHOLE[:n] for n in range(len(WHOLE))]
    marks = [i for i in range(len(WHOLE)) if WHOLE[i : i + 1] in (b"*", b"$")]
    out += [WHOLE[:i] + m + WHOLE[i + 1 :] for i in marks for m in (b"+", b":", b"#")]
    out += [WHOLE[: i + 1] + n + WHOLE[i + 2 :] for i in marks for n in (b"", b"-2", b"x", b"1 ", b"+3", str(1 << 63).encode(), b"9" * 30)]
    out += [WHOLE[: i + 1] + n + WHOLE[i + 2 :] for i in marks[1:] for n in (b"1", b"8")]
    return [*out, WHOLE.replace(b"*3", b"*4"), WHOLE.replace(b"*3", b"*1025"), WHOLE.replace(b"\r", b"")]


def test_malformed_frames():
    assert resp.parse(WHOLE) == ([b"SET", b"k1", b"value"], len(WHOLE))
    for frame in _damaged():
        assert resp.parse(frame) is None, frame


@given(st.binary(max_size=60))
def test_no_frame_crashes(data):
    got = resp.parse(data)
    assert got is None or got[1] <= len(data)


def test_pipelined_frames(spark):
    two = b"*1\r\n$4\r\nPING\r\n*2\r\n$3\r\nGET\r\n$0\r\n\r\n"
    df = spark.createDataFrame([(1, 1, bytearray(two)), (1, 2, bytearray(two[:-3])), (2, 1, bytearray(b"")), (2, 2, None), (2, 3, bytearray(b"*0\r\n"))], "conn int, seq long, bytes binary")
    got = rows(resp.decode(df).select("conn", "seq", "pos", "ok", F.coalesce(F.array_size("args"), F.lit(-1)).alias("n")))
    assert got == [(1, 1, 0, True, 1), (1, 1, 1, True, 2), (1, 2, 0, True, 1), (1, 2, 1, False, -1), (2, 1, 0, False, -1), (2, 3, 0, True, 0)]


def test_a_conversation(spark):
    talk = [
        (["PING"], b"+PONG\r\n"), (["set", "foo", "bar"], b"+OK\r\n"), (["GET", "foo"], b"$3\r\nbar\r\n"), (["EXISTS", "foo"], b":1\r\n"), (["DEL", "foo", "foo", "zz"], b":1\r\n"), (["GET", "foo"], b"$-1\r\n"),
        (["EXISTS", "foo"], b":0\r\n"), (["DEL", "foo"], b":0\r\n"), (["SET", "foo", ""], b"+OK\r\n"), (["GET", "foo"], b"$0\r\n\r\n"), (["GET"], resp.WRONG_ARGS), (["SET", "a", "b", "EX"], resp.WRONG_ARGS), (["DEL"], resp.WRONG_ARGS),
        (["EXISTS", "a", "b"], resp.WRONG_ARGS), (["PING", "hi"], b"$2\r\nhi\r\n"), (["ECHO", "x"], b"$1\r\nx\r\n"), (["ECHO"], b"$-1\r\n"), (["quit"], b"+OK\r\n"), (["FLUSHALL"], resp.UNKNOWN), ([], resp.EMPTY), (None, resp.EMPTY),
    ]
    df = spark.createDataFrame([(i, None if a is None else [bytearray(x.encode()) for x in a]) for i, (a, _) in enumerate(talk)], "seq long, args array<binary>")
    assert [bytes(r.reply) for r in resp.dispatch(df).orderBy("seq").collect()] == [r for _, r in talk]


# --- log files ---


@given(st.sampled_from(["set", "del"]), st.text(max_size=20), st.binary(max_size=30), st.integers(-(1 << 63), (1 << 63) - 1), st.text(max_size=8))
def test_entries_round_trip(op, key, value, ts, node):
    assert wire.decode_entry(wire.encode_entry(op, key, value, ts, node)) == (op, key, value if op == "set" else None, ts, node)


@given(st.binary(max_size=40))
def test_garbage_is_an_error_and_never_a_crash(data):
    try:
        wire.decode_entry(data)
    except wire.CorruptLog:
        pass


def test_log_round_trip_and_damage(spark, log, tmp_path):
    lg = log(*(("set", f"k{i}", bytes([i]), i, "n") for i in range(50)), ("del", "k1", None, 99, None))
    path = str(tmp_path / "log")
    segments.append(lg, path, 4)
    back = segments.read(spark, path)
    assert rows(back.select("op", "key", "ts")) == rows(lg.select("op", "key", "ts"))
    assert back.where("key = 'k1'").orderBy("seq").select("op").collect()[-1].op == "del"
    assert segments.read(spark, f"file://{path}").count() == lg.count()
    segments.append(lg, f"file://{path}2", 2)
    assert rows(segments.read(spark, f"{path}2").select("key", "ts")) == rows(lg.select("key", "ts"))
    victim = sorted((tmp_path / "log").glob("*.log"))[0]
    victim.write_bytes(victim.read_bytes() + b"\0\0\0\x09bad")
    with pytest.raises(Exception, match="ends early"):
        segments.read(spark, path).count()
    assert segments.read(spark, path, "permissive").count() == 51


def test_order_of_a_hot_key_over_slices_and_appends(spark, log, tmp_path):
    path = str(tmp_path / "log")
    for first in (0, 200):
        lg = log(*(("set", "hot" if i % 3 else f"k{i}", str(first + i).encode(), 7, "n") for i in range(200)))
        segments.append(lg, path, 4, slice_rows=30)
    back = [int(r.value) for r in segments.read(spark, path).where("key = 'hot'").orderBy("seq").collect()]
    assert back == [f + i for f in (0, 200) for i in range(200) if i % 3]
    assert len(list((tmp_path / "log").glob("segment-*.log"))) > 8


def test_messages_from_peers(spark):
    ok = [wire.encode_entry("set", "k", b"v", 5, "n"), wire.encode_entry("del", "k", None, 6, "n")]
    df = spark.createDataFrame([(bytearray(b),) for b in (*ok, b"garbage", b"")] + [(None,)], "bytes binary")
    assert rows(gossip.decoded(df)) == [("del", "k", None, 6, "n"), ("set", "k", b"v", 5, "n")]


# --- stores ---


def test_snapshot_and_tail(spark, log):
    s = StateStore(spark, shared_path(spark, "s"))
    assert s.state().count() == 0
    s.append(log(("set", "persist1", b"1", 1, "n"), ("set", "persist2", b"2", 1, "n")))
    assert s.snapshot() == 1 and s.has(1)
    s.append(spark.createDataFrame([(3, "set", "persist3", bytearray(b"3"), 1, "n"), (4, "del", "persist2", None, 2, "n")], LOG))
    s.clear_log()
    assert s.log().count() == 2
    assert {r.key for r in fold.live(s.state()).collect()} == {"persist1", "persist3"}
    assert s.snapshot() == 2
    s.clear_log()
    assert s.log().count() == 0 and {r.key for r in fold.live(StateStore(spark, s.path).state()).collect()} == {"persist1", "persist3"}
    with pytest.raises(RuntimeError):
        StateStore(spark, shared_path(spark, "s"), snapshots=False).snapshot()


def test_volatile_log(spark, log):
    s = StateStore(spark, shared_path(spark, "s"), durable_log=False)
    s.append(log(("set", "k", b"1", 1, "n")))
    assert s.log().count() == 0


def test_single_operations(spark):
    kv = KVStore(spark, shared_path(spark, "kv"), "node-01")
    assert kv.get("a") is None and not kv.delete("a")
    kv.set("a", b"1")
    kv.set_many({"b": b"", "c": None})
    assert (kv.get("a"), kv.get("b"), kv.exists("c"), kv.exists("zz")) == (b"1", b"", True, False)
    kv.apply("set", "a", b"stale", 5, "x")
    assert kv.get("a") == b"1"
    assert kv.delete("a") and kv.get("a") is None and not kv.delete("a")
    kv.snapshot()
    again = KVStore(spark, kv.store.path, "node-01")
    again.set("a", b"new")
    assert again.get("a") == b"new"
    peer = KVStore(spark, shared_path(spark, "kv"), "node-02")
    peer.sync_from(again)
    assert peer.root() == again.root() and peer.get("a") == b"new"
    assert again.pull_for(peer).count() == 0


def test_command_line(spark, tmp_path, capsys):
    p = ["--path", str(tmp_path / "kv")]
    assert main([*p, "get", "k"]) == 1
    assert main([*p, "set", "k", "v"]) == 0 and main([*p, "get", "k"]) == 0
    assert capsys.readouterr().out.split() == ["OK", "v"]
    assert main([*p, "delete", "k"]) == 0 and main([*p, "delete", "k"]) == 1
    assert main(["--path", "nofs://x", "get", "k"]) == 2


# --- streams ---


def test_stream_equals_batch(spark, log, tmp_path):
    r = random.Random(4)
    lg = log(*((r.choice(["set", "set", "del"]), f"k{r.randint(0, 9)}", r.choice([b"x", b"y"]), r.randint(1, 9), r.choice([None, "n1", "n2"])) for _ in range(60)))
    for i in range(3):
        lg.where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = merge.log_feed(spark, str(tmp_path / "in"), lg.schema, 1)
    out: dict = {}

    def keep(batch, _):
        out.update({x.key: (x.ts, x.node_id or "", x.tombstone, x.value) for x in batch.collect()})

    merge.merged(feed).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert out == {x.key: (x.ts, x.node_id or "", x.tombstone, x.value) for x in _folded(lg).collect()}
    store = StateStore(spark, str(tmp_path / "store"))
    merge.persist(merge.log_feed(spark, str(tmp_path / "in"), lg.schema, 1), store, str(tmp_path / "c2"), snapshot_every=0).awaitTermination()
    assert rows(store.state()) == rows(_folded(lg))


def test_snapshots_cover_files_and_lose_no_late_rows(spark, log):
    r = random.Random(9)
    lg = log(*((r.choice(["set", "set", "del"]), f"k{r.randint(0, 30)}", b"x", r.randint(1, 99), "n1") for _ in range(90)))
    store = StateStore(spark, shared_path(spark, "late"))
    for n, (lo, hi) in enumerate([(60, 90), (0, 30), (30, 60)]):
        store.append(lg.where(f"seq > {lo} and seq <= {hi}"))
        if n < 2:
            store.snapshot()
    want = rows(_folded(lg))
    assert rows(store.state()) == want
    store.clear_log()
    assert sorted(x.seq for x in store.log().collect()) == [*range(31, 61)] and rows(store.state()) == want
    assert store.snapshot() == 3 and rows(store.state()) == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_streamed_query_has_batches_snapshots_and_a_tail(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(state, "StateStore", lambda *a: kept.append(StateStore(*a)) or kept[0])
    found = state.stream_persisted(spark, DIR)
    (store,) = kept
    m = store._latest()
    assert m["version"] == 2 and 0 < len(m["files"]) < len(store._files())
    assert rows(found.select(*ENTRY)) == rows(_folded(state.log_of(spark, DIR), state.FAMILY).select(*ENTRY))


# --- settings ---


def test_defaults_and_checks():
    ok = StoreConfig.default().set(insecure=True)
    assert ok.check() is ok
    assert (ok.wal_interval, ok.snapshot_interval, ok.wal_buffer, ok.wal_segments, ok.lru.capacity, ok.gossip_interval, ok.cluster.replication_factor, ok.cluster.failure_mode) == (500, 300_000, 65536, 16, 10_000, 10_000, 3, "strict")
    assert Cluster(replication_factor=-2).replication_factor == 1
    for missing in ("wal_path", "snapshot_path", "wal_interval", "snapshot_interval", "wal_buffer", "wal_segments", "clock", "bind_addr", "gossip_interval", "failure_mode"):
        kind = type(getattr(ok, missing, None) or getattr(ok.cluster, missing, ""))
        with pytest.raises(ValueError, match=missing):
            ok.set(**{missing: kind()}).check()
    with pytest.raises(ValueError, match="credentials"):
        StoreConfig.default().check()
    assert ok.set(gossip_interval=0, single_node=True).check()
    assert ok.volatile().disable_wal and ok.volatile().disable_snapshot


def test_layers():
    c = StoreConfig.layered({"wal_segments": 3, "node_id": None}, {"KEYFOLD_WAL_SEGMENTS": "9", "KEYFOLD_GRPC_PORT": "7", "KEYFOLD_DISABLE_WAL": "true"})
    assert (c.wal_segments, c.cluster.grpc_port, c.disable_wal, c.wal_interval) == (3, 7, True, 500)


def test_entries_that_are_not_written_become_tombstones(spark, log, tmp_path):
    lg = log(("set", "a", b"1", 1, "n"), ("set", "b", b"1", 1, "n"), ("del", "b", None, 2, "n"))
    lg.coalesce(1).write.parquet(str(tmp_path / "in"))
    out: dict = {}

    def keep(batch, _):
        for x in batch.collect():
            out.setdefault(x.key, []).append(x.tombstone)

    q = merge.merged(merge.log_feed(spark, str(tmp_path / "in"), lg.schema), ttl_ms=1500).writeStream.outputMode("update").foreachBatch(keep)
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            if len(out.get("a", [])) == 2 or q.exception():
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert out == {"a": [False, True], "b": [True]}


def test_a_stream_that_stops_goes_on_where_it_was(spark, log, tmp_path):
    lg = log(*(("set", f"k{i % 4}", bytes([i]), i, "n") for i in range(12)))
    out: dict = {}

    def keep(batch, _):
        out.update({x.key: bytes(x.value) for x in batch.collect()})

    for half in ("seq <= 6", "seq > 6"):
        lg.where(half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = merge.merged(merge.log_feed(spark, str(tmp_path / "in"), lg.schema)).writeStream.outputMode("update").foreachBatch(keep)
        s.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    # A late write after the restart loses against the state that was kept.
    log(("set", "k3", b"late", 2, "n")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = merge.merged(merge.log_feed(spark, str(tmp_path / "in"), lg.schema)).writeStream.outputMode("update").foreachBatch(keep)
    s.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert out == {f"k{i}": bytes([8 + i]) for i in range(4)}
