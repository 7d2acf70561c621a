from __future__ import annotations

import random

from pyspark.sql import functions as F

from keyfold.operators import fold, recovery
from keyfold.streaming.merge import plain_item_hash

from .conftest import ENTRIES, LOG, rows

PINNED = [  # op, key, value, ts, node; accepted
    (("set", "same-node", b"first", 100, "node-1"), True),
    (("set", "same-node", b"first", 100, "node-1"), False),
    (("set", "same-node", b"older", 99, "node-1"), False),
    (("set", "same-node", b"newer", 101, "node-1"), True),
    (("set", "same-node", b"lower-node", 101, "node-0"), False),
    (("set", "same-node", b"higher-node", 101, "node-2"), True),
]


def test_merge_order(log):
    judged = fold.judged(log(*(c for c, _ in PINNED))).orderBy("seq").collect()
    assert [r.accepted for r in judged] == [a for _, a in PINNED]
    assert rows(fold.fold(fold.as_entries(log(*(c for c, _ in PINNED))))) == [("same-node", b"higher-node", 101, "node-2", False)]


def test_ties_converge_by_item_hash(log):
    a, b = ("set", "same-node", b"first", 100, "node-1"), ("set", "same-node", b"second", 100, "node-1")
    one, other = (fold.fold(fold.as_entries(log(*x))) for x in ((a, b), (b, a)))
    assert rows(one) == rows(other) == [("same-node", b"first", 100, "node-1", False)]
    accepted = [sum(r.accepted for r in fold.judged(log(*x)).collect()) for x in ((a, b), (b, a))]
    assert sorted(accepted) == [1, 2]


def test_stale_writes_and_tombstones(log):
    steps = [("set", "user:1", b"a", 100, "n"), ("set", "user:1", b"b", 101, "n"), ("set", "user:1", b"c", 90, "n"), ("del", "user:1", None, 105, "n"), ("del", "user:1", None, 95, "n"), ("set", "user:1", b"late", 50, "n")]
    assert [r.accepted for r in fold.judged(log(*steps)).orderBy("seq").collect()] == [True, True, False, True, False, False]
    state = fold.fold(fold.as_entries(log(*steps)))
    assert rows(state) == [("user:1", None, 105, "n", True)]
    assert fold.live(state).count() == 0


def _random_log(r: random.Random, n: int) -> list[tuple]:
    return [
        (r.choice(["set", "set", "del"]), r.choice(["a", "b", "c", "", None]), r.choice([None, b"", b"x", b"y", b"z" * 50]), r.choice([-1, 0, 1, 2, 3]), r.choice([None, "", "node-1", "node-2"]))
        for _ in range(n)
    ]


def _brute(steps: list[tuple]) -> dict:
    best: dict = {}
    for op, k, v, ts, n in steps:
        dead = op == "del"
        v = None if dead else v
        rank = (ts, (n or "").encode(), plain_item_hash(k, v, ts, n, dead))
        if k not in best or rank > best[k][0]:
            best[k] = (rank, v or b"", dead)
    return best


def test_any_order_and_repetition_gives_one_state(log, spark):
    r = random.Random(5)
    steps = _random_log(r, 120)
    want = {k: (rank[0], rank[1], v, dead) for k, (rank, v, dead) in _brute(steps).items()}
    for _ in range(3):
        again = steps + r.sample(steps, 40)
        r.shuffle(again)
        got = {x.key: (x.ts, (x.node_id or "").encode(), bytes(x.value or b""), x.tombstone) for x in fold.fold(fold.as_entries(log(*again))).collect()}
        assert got == want


def test_judged_like_a_loop(log):
    steps = _random_log(random.Random(6), 150)
    best, want = {}, []
    for op, k, v, ts, n in steps:
        dead = op == "del"
        rank = (ts, (n or "").encode(), plain_item_hash(k, None if dead else v, ts, n, dead))
        want.append(k not in best or rank > best[k])
        best[k] = max(rank, best.get(k, rank))
    assert [x.accepted for x in fold.judged(log(*steps)).orderBy("seq").collect()] == want


def test_null_and_empty_payload_stay_apart(log):
    got = rows(fold.fold(fold.as_entries(log(("set", "nil", None, 1, "n"), ("set", "empty", b"", 1, "n")))))
    assert got == [("empty", b"", 1, "n", False), ("nil", None, 1, "n", False)]


def test_empty_log(spark):
    none = spark.createDataFrame([], LOG)
    assert fold.fold(fold.as_entries(none)).count() == fold.judged(none).count() == fold.deletes_existed(none).count() == 0


def test_deletes(log):
    steps = [("del", "a", None, 1, "n"), ("set", "a", b"x", 2, "n"), ("del", "a", None, 3, "n"), ("del", "a", None, 4, "n")]
    for cluster in (False, True):
        got = [(r.existed, r.writes) for r in fold.deletes_existed(log(*steps), cluster).orderBy("seq").collect()]
        assert got == [(False, cluster), (True, True), (False, cluster)]


def test_replay_keeps_the_first_of_equal_clocks(log):
    got = rows(fold.replay_by_clock(log(("set", "k", b"first", 5, "a"), ("set", "k", b"second", 5, "b"), ("set", "k", b"old", 4, "c"))))
    assert got == [("k", b"first", 5, None, False)]


def test_reads(log, spark):
    lg = log(("set", "a", b"1", 1, "n"), ("set", "b", b"2", 1, "n"), ("del", "b", None, 2, "n"))
    assert rows(fold.get(lg, "a")) == [("a", b"1", 1, "n", False)]
    assert fold.get(lg, "b").count() == 0
    keys = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "key string")
    assert rows(fold.multi_get(fold.fold(fold.as_entries(lg)), keys)) == sorted([("a", b"1", True), ("b", None, False), ("zz", None, False), (None, None, False)], key=repr)


def test_columns_that_clash_are_not_read(spark):
    df = spark.createDataFrame([(1, "set", "k", bytearray(b"v"), 1, "n", 9, "x", True)], LOG + ", rank int, w string, tombstone boolean")
    assert rows(fold.fold(fold.as_entries(df))) == [("k", b"v", 1, "n", False)]


def test_recovery_and_segments(log):
    steps = _random_log(random.Random(8), 80)
    whole = fold.fold(fold.as_entries(log(*steps)))
    lg = log(*steps)
    old = fold.fold(fold.as_entries(lg.where("seq <= 40")))
    for start in (40, 20):  # an overlap does no harm
        same = recovery.recover(old, lg.where(F.col("seq") > start))
        assert [x[:3] for x in rows(same)] == [x[:3] for x in rows(whole)]
    seg = recovery.segmented(lg.where("key is not null"), 3)
    kept = recovery.clear(seg, recovery.offsets(seg, 40))
    assert {r.seq for r in kept.collect()} == {r.seq for r in seg.where("seq > 40").collect()}
    assert recovery.clear(seg, None).count() == 0


def test_entry_schema_survives(entries, spark):
    assert fold.fold(entries(("k", None, None, None, False))).count() == 1
    assert fold.fold(spark.createDataFrame([], ENTRIES)).columns == fold.ENTRY
