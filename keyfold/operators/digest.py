"""Three-level digests of key state, and the exchange that brings two replicas together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.functions.hashing import SHARDS, SUBS, mix_count
from keyfold.operators.fold import ENTRY, fold
from keyfold.operators.ring import Ring


def sums(hashed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``shard, sub, x, cnt`` of the buckets that hold items, of each group ``by``; folded before the shuffle, 8,192 rows a group at most."""
    return hashed.groupBy(*by, "shard", "sub").agg(F.bit_xor("item_hash").alias("x"), F.count("*").alias("cnt"))


def _digest(x: str = "x", cnt: str = "cnt") -> Column:
    return F.col(x).bitwiseXOR(mix_count(F.col(cnt)))


def _whole(sums: DataFrame) -> DataFrame:
    """All buckets, the empty ones with 0."""
    spine = sums.sparkSession.range(SHARDS * SUBS, numPartitions=1).select((F.col("id") / SUBS).cast("int").alias("shard"), (F.col("id") % SUBS).cast("int").alias("sub"))
    zero = F.lit(0).cast("long")
    return spine.join(sums, ["shard", "sub"], "left").select("shard", "sub", F.coalesce("x", zero).alias("x"), F.coalesce("cnt", zero).alias("cnt"))


def _by_shard(whole: DataFrame) -> DataFrame:
    """XORs and counts add up, so shards follow from buckets."""
    return whole.groupBy("shard").agg(F.bit_xor("x").alias("x"), F.sum("cnt").alias("cnt"))


def sub_digests(hashed: DataFrame) -> DataFrame:
    """``shard, sub, cnt, digest`` of all 8,192 buckets. Tombstones count. An empty bucket has the digest of count 0."""
    return _whole(sums(hashed)).select("shard", "sub", "cnt", _digest().alias("digest"))


def shard_digests(hashed: DataFrame) -> DataFrame:
    """``shard, cnt, digest`` of all 128 shards: of the items of the shard, not of its bucket digests."""
    return _by_shard(_whole(sums(hashed))).select("shard", "cnt", _digest().alias("digest"))


def root_of_sums(digests: DataFrame) -> DataFrame:
    """``cnt, digest`` of the state whose bucket sums (``shard, sub, x, cnt``) these are."""
    return _by_shard(_whole(digests)).select("cnt", _digest().alias("digest")).agg(F.sum("cnt").alias("cnt"), F.bit_xor("digest").alias("digest"))


def root_digest(hashed: DataFrame) -> DataFrame:
    """``cnt, digest`` of the whole state; 0 when it is empty."""
    return shard_digests(hashed).agg(F.sum("cnt").alias("cnt"), F.bit_xor("digest").alias("digest"))


def mismatched(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``shard, sub`` of the buckets whose digests differ, in shards whose digests differ, within each group ``by``, such as a replica.

    One aggregation of each state; all the rest has 8,192 rows."""
    sides = sums(a, by).select("*", F.lit("a").alias("side")).unionByName(sums(b, by).select("*", F.lit("b").alias("side")))
    zero = F.lit(0).cast("long")
    of = lambda c, s: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), zero).alias(f"{c}{s}")
    both = sides.groupBy(*by, "shard", "sub").agg(*(of(c, s) for c in ("x", "cnt") for s in "ab"))
    w = Window.partitionBy(*by, "shard")  # 64 rows
    up = both.select("*", *(F.bit_xor(f"x{s}").over(w).alias(f"shard_x{s}") for s in "ab"), *(F.sum(f"cnt{s}").over(w).alias(f"shard_cnt{s}") for s in "ab"))
    bad_shard = _digest("shard_xa", "shard_cnta") != _digest("shard_xb", "shard_cntb")
    return up.where(bad_shard & (_digest("xa", "cnta") != _digest("xb", "cntb"))).select(*by, "shard", "sub")


def request(hashed: DataFrame) -> DataFrame:
    """What a replica asks with: ``level`` (``root``, ``shard``, ``sub``), ``shard, sub, cnt, digest``; 8,321 rows."""
    whole = _whole(sums(hashed))
    none = F.lit(None).cast("int")
    sub = whole.select(F.lit("sub").alias("level"), "shard", "sub", "cnt", _digest().alias("digest"))
    shard = _by_shard(whole).select(F.lit("shard").alias("level"), "shard", none.alias("sub"), "cnt", _digest().alias("digest"))
    root = shard.agg(F.sum("cnt").alias("cnt"), F.bit_xor("digest").alias("digest")).select(F.lit("root").alias("level"), none.alias("shard"), none.alias("sub"), "cnt", "digest")
    return root.unionByName(shard).unionByName(sub)


def answer(asked: DataFrame, peer: DataFrame) -> DataFrame:
    """Entries of ``peer`` (hashed) that a request is answered with.

    Nothing if the roots are equal, nothing of a shard whose digests are equal, else the buckets whose digests differ. A
    missing root or shard counts as different; a shard of which not all 64 bucket digests were sent is sent whole.
    """
    own = request(peer)
    mine = own.select("level", "shard", "sub", F.col("digest").alias("own"))
    sent = asked.groupBy("level", "shard", "sub").agg(F.max("digest").alias("digest"))
    both = mine.alias("m").join(sent.alias("s"), (F.col("m.level") == F.col("s.level")) & F.col("m.shard").eqNullSafe(F.col("s.shard")) & F.col("m.sub").eqNullSafe(F.col("s.sub")), "left").select("m.*", "digest")
    both = both.withColumn("differs", ~F.col("own").eqNullSafe(F.col("digest")))
    per = both.groupBy("shard").agg(F.bool_or((F.col("level") == "shard") & F.col("differs")).alias("shard_differs"), F.count_if((F.col("level") == "sub") & F.col("digest").isNotNull()).alias("sent"))
    root = both.where("level = 'root'").select(F.col("differs").alias("root_differs"))
    bad = both.where("level = 'sub'").join(F.broadcast(per), "shard").where(F.col("shard_differs") & (F.col("differs") | (F.col("sent") < SUBS)))
    first = root.first()  # one row, one flag
    if first is not None and not first[0]:
        return peer.limit(0).select(*ENTRY)
    return peer.join(F.broadcast(bad.select("shard", "sub")), ["shard", "sub"], "left_semi").select(*ENTRY)


def update_digests(digests: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Sub-bucket XORs and counts after entries changed: ``shard, sub, cnt, x`` with the old items taken out and the new put in."""
    base = digests.select("shard", "sub", "cnt", "x")
    delta = sums(old).select("shard", "sub", (-F.col("cnt")).alias("cnt"), "x").unionByName(sums(new).select("shard", "sub", "cnt", "x"))
    return base.unionByName(delta).groupBy("shard", "sub").agg(F.sum("cnt").alias("cnt"), F.bit_xor("x").alias("x"))


def pull(requester: DataFrame, peer: DataFrame, node: str | Column | None = None, ring: Ring | None = None, rf: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """What ``peer`` sends: all its entries in mismatched buckets, tombstones as deletions. Both states are hashed.

    With a ring, only entries of which ``node`` is an owner. A peer doesn't know which entries of a bucket differ; the
    merge drops those that don't. The bucket list has at most 8,192 rows. With ``by``, such as a replica, many pairs exchange at
    once: ``requester`` and ``peer`` have those columns, equal for the two of a pair.
    """
    bad = mismatched(requester, peer, by)
    sent = peer.join(bad if by else F.broadcast(bad), [*by, "shard", "sub"], "left_semi")
    if ring is not None and node is not None:
        sent = ring.place(sent, max(rf, 1)).where(F.array_contains("owners", node)).drop("owners")
    return sent.select(*by, *ENTRY)


def merge(state: DataFrame, *deltas: DataFrame, family: str = "xxh64") -> DataFrame:
    """State after the entries of ``deltas`` were applied to it."""
    return fold(reduce(DataFrame.unionByName, (d.select(*ENTRY) for d in (state, *deltas))), family)


def empty_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, value binary, ts long, node_id string, tombstone boolean")
