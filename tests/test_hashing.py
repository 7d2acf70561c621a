from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyfold.functions import hashing as H

VECTORS = [("user:1", "d9c7c4609e6080f3", 115, 32, 3), ("test", "4fdcca5ddb678139", 57, 39, 9), ("same-node", "0f324ee4d42002e9", 105, 32, 9)]


@pytest.mark.parametrize("how", ["catalyst", "arrow"])
def test_key_hash_has_seed_zero(spark, how):
    keys = ["", "é", "x" * 1000, *(v[0] for v in VECTORS)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", H.xx64(F.col("k"), 0, how).alias("h"), H.xx64(F.col("k").cast("binary"), 0, how).alias("b")).collect()
    for r in got:
        assert r.h % (1 << 64) == r.b % (1 << 64) == xxhash.xxh64_intdigest(r.k.encode())


def test_null_key_hashes_to_the_seed(spark):
    assert spark.sql("select cast(null as string) k").select(H.xx64(F.col("k")), H.xx64(F.col("k"), 0, "arrow"), H.sha64(F.col("k"))).first()[:] == (0, 0, 0)


def test_placement_vectors(spark):
    h = H.key_hash(F.col("k"))
    df = spark.createDataFrame([(v[0],) for v in VECTORS], "k string").select("k", H.long_to_hex(h).alias("x"), H.shard_of(h).alias("s"), H.sub_of(h).alias("b"), H.unsigned_mod(h, 16).alias("g"), H.unsigned_mod(h, 3).alias("m"))
    got = {r.k: r for r in df.collect()}
    for k, x, s, b, g in VECTORS:
        assert (got[k].x, got[k].s, got[k].b, got[k].g, got[k].m) == (x, s, b, g, int(x, 16) % 3)


def test_item_hash_vectors(spark):
    rows = [("same-node", 100, "node-1", b"first", False), ("same-node", 100, "node-1", b"second", False), ("user:1", 105, "node-1", None, True)]
    df = spark.createDataFrame([(k, t, n, None if v is None else bytearray(v), d) for k, t, n, v, d in rows], "k string, ts long, n string, v binary, d boolean")
    h = H.item_hash(H.key_hash(F.col("k")), F.col("ts"), F.col("n"), F.col("v"), F.col("d"))
    assert [r[0] for r in df.select(H.long_to_hex(h)).collect()] == ["66aaa3fa4d658799", "211c2089a236d369", "a2a71a6740d5a289"]


def test_ring_hash_and_back(spark):
    r = spark.sql("select 'user:1' k").select(H.hex_hash(F.col("k")).alias("h"), H.long_to_hex(H.hex_to_long(H.hex_hash(F.col("k")))).alias("b")).first()
    assert r.h == r.b == "abc3a47b8ad18b85"


def test_mix_count(spark):
    def plain(n):
        x = n + 1
        for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> s)) * m) % (1 << 64)
        return x ^ (x >> 31)

    got = [r[0] for r in spark.range(300, numPartitions=1).select(H.long_to_hex(H.mix_count(F.col("id")))).collect()]
    assert got == [f"{plain(n):016x}" for n in range(300)]
    assert (got[0], got[1], got[3]) == ("5692161d100b05e5", "dbd238973a2b148a", "b7a4712c74562914")


def test_unsigned_order(spark):
    r = random.Random(1)
    xs = [r.getrandbits(64) for _ in range(200)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in xs], "h long")
    assert [x[0] % (1 << 64) for x in df.orderBy(H.unsigned_order(F.col("h"))).collect()] == sorted(xs)


def test_numpy_twin_of_the_engine_hash(spark):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-(1 << 63), (1 << 63) - 1, 500) for _ in range(2))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long").coalesce(1)
    assert [r[0] for r in df.select(F.xxhash64("a", "b")).collect()] == H.np_xx64_longs(a, b).tolist()
