"""Mixing sources to target weights: blocks of equal size in tokens, apportioned by highest quotients."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm import tokens
from keyfold.llm.text import slices
from keyfold.session import cut

#: Size of a block at most; where the smallest quota of a mix would get fewer than MIN_BLOCKS of them, the blocks of that mix are smaller.
BLOCK_TOKENS, MIN_BLOCKS, LEAST_BLOCK = 1024, 1000, 16
#: Tokens that a shard of a source should hold, and how many shards a source has at most.
SHARD_TOKENS, MAX_SHARDS = 4_000_000, 4096
#: Rows of targets that the driver takes.
MAX_TARGETS = 100_000


def count_tokens(docs: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """``doc_id, source, n``: whole texts in tokens of the public byte-level vocabulary; null text has 0."""
    id_type = docs.schema[doc].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.byte_bpe(folder).encode_ordinary
        for part in slices(batches, 2):
            n = [len(encode(t)) if t else 0 for t in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n"])

    return docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id {id_type}, source string, n long")


def apportion(seats: int, weights: list[float], caps: list[int]) -> list[int]:
    """Sainte-Lague: each seat in turn to the party with the highest quotient ``weight / (2 * seats + 1)`` that has room.

    Ties go to the earlier party. A divisor is searched that gives all but the last few seats at once, so the work
    doesn't grow with their number. Parties without weight get none; if all room is taken, seats stay empty.
    """
    w, cap = np.array(weights, float), np.array(caps, np.int64)
    cap = np.where(w > 0, np.maximum(cap, 0), 0)
    if not len(w) or seats <= 0 or not cap.sum():
        return [0] * len(w)
    if cap.sum() <= seats:
        return cap.tolist()

    def given(d: float) -> np.ndarray:
        return np.minimum(cap, np.floor(w / d + 0.5).astype(np.int64))

    low, high = w.max() / (seats + 1) / 4, 4 * w.sum()
    low = min(low, w[w > 0].min() / (cap.max() + 1))
    while given(high).sum() > seats:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = given(high * (1 + 1e-12))  # short of ties, which the last seats decide
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        i = heapq.heappop(heap)[1]
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got.tolist()


def _plan(targets: list[dict], shards: dict[str, list[tuple[int, int]]], total: int | None) -> list[tuple]:
    """``mix, source, shard, tokens, blocks, rounds, extra``: what each mix takes of each shard. ``shards``: their numbers and tokens.

    Each mix has blocks of its own size, so that it doesn't depend on what other mixes are asked for. The room of a source is that of
    its shards, in their own whole blocks, so that every block it is given finds a place. By default there are as many blocks as
    every source can give in proportion."""
    mixes: dict = {}
    for t in targets:
        mixes.setdefault(t["mix_id"], []).append(t)
    out = []
    for mix, ts in mixes.items():
        able = [t for t in ts if t["weight"] > 0 and t["max_repeats"] > 0 and shards.get(t["source"])]
        if not able:
            continue
        weights = [t["weight"] for t in able]
        sum_w = sum(weights)
        size = [sum(n for _, n in shards[t["source"]]) for t in able]
        most = min(n * t["max_repeats"] * sum_w / t["weight"] for n, t in zip(size, able, strict=True))
        wanted = most if total is None else total
        block = max(LEAST_BLOCK, min(BLOCK_TOKENS, int(wanted * min(weights) / sum_w // MIN_BLOCKS)))
        blocks = [[max(1, round(n / block)) for _, n in shards[t["source"]]] for t in able]
        caps = [sum(b) * t["max_repeats"] for b, t in zip(blocks, able, strict=True)]
        seats = round(wanted / block)
        if total is None:
            seats = min(seats, *(int(c * sum_w / w) for c, w in zip(caps, weights, strict=True)))
        for t, b, quota in zip(able, blocks, apportion(seats, weights, caps), strict=True):
            own = shards[t["source"]]
            for (shard, n), k, got in zip(own, b, apportion(quota, [n for _, n in own], [k * t["max_repeats"] for k in b]), strict=True):
                if got:
                    out.append((mix, t["source"], shard, n, k, got // k, got % k))
    return out


def mix(counted: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None) -> DataFrame:
    """``mix_id, source, doc_id, n, copies``: the documents of every mix and how often each is used.

    ``counted`` has ``doc_id, source, n`` (see ``count_tokens``), ``targets`` ``mix_id, source, weight, max_repeats``.
    Weights of a mix are relative to each other; null and negative ones count as 0, null ``max_repeats`` as 1, and
    several rows of one source add up with the largest ``max_repeats``. A source with weight 0, without tokens or of null
    name is in no mix; the others share in proportion. ``total``: size of each mix in tokens; by default the largest at
    which every source reaches its share within ``max_repeats``. With a ``total`` beyond that, sources that run
    out stay below their share. Rows of ``counted`` without tokens are never used; each other row is a document.

    The documents of a source fall into shards by hash, and are cut in seeded order into blocks of one size
    in tokens; a document belongs to the block that holds its middle. Blocks are apportioned to sources by
    Sainte-Lague, then to the shards of each source in the same way; a shard uses all its blocks as often as the quota
    has whole rounds, and the first blocks of the seeded order once more. Windows sort one shard. To the driver go the
    targets (checked to be at most MAX_TARGETS) and one row for each shard (MAX_SHARDS at most for a source of the
    targets). ``counted`` is materialised in the shared folder, as tokenizing twice would cost more than all the rest.
    """
    spark = counted.sparkSession
    id_type = targets.schema["mix_id"].dataType.simpleString()
    doc_type = counted.schema["doc_id"].dataType.simpleString()
    rows = (
        targets.where("source is not null and mix_id is not null")
        .groupBy("mix_id", "source")
        .agg(F.sum(F.greatest(F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
        .orderBy("mix_id", "source").limit(MAX_TARGETS + 1).collect()
    )
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    targets_ = [r.asDict() for r in rows]
    names = sorted({t["source"] for t in targets_})
    empty = f"mix_id {id_type}, source string, doc_id {doc_type}, n long, copies int"
    if not names:
        return spark.createDataFrame([], empty)
    known = spark.createDataFrame([(s,) for s in names], "source string")
    docs = cut(counted.where("n > 0").join(F.broadcast(known), "source", "left_semi").select("doc_id", "source", "n"))
    size = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if not size:
        return spark.createDataFrame([], empty)
    counts = spark.createDataFrame([(s, int(max(1, min(MAX_SHARDS, -(-n // SHARD_TOKENS))))) for s, n in size.items()], "source string, shards int")
    sharded = docs.join(F.broadcast(counts), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "doc_id"), F.col("shards")).cast("int")).drop("shards")
    per: dict[str, list] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("n").alias("n")).orderBy("source", "shard").collect():
        per.setdefault(r["source"], []).append((r["shard"], r["n"]))
    plan = spark.createDataFrame(_plan(targets_, per, total), f"mix_id {id_type}, source string, shard int, total long, blocks int, rounds int, extra int")

    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sharded.withColumn("middle", F.sum("n").over(w) - F.col("n") / 2)
    which = F.floor(F.col("middle") * F.col("blocks") / F.col("total"))
    return (
        placed.join(plan, ["source", "shard"])
        .withColumn("copies", (F.col("rounds") + F.when(which < F.col("extra"), 1).otherwise(0)).cast("int"))
        .where("copies > 0")
        .select("mix_id", "source", "doc_id", "n", "copies")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_id, source``, ``target_share`` of all weights of the mix and ``reached_share`` of its tokens, with ``tokens``,
    ``documents``, ``uses`` and ``most_uses`` of a document; sources that got nothing are listed with 0.

    ``due_share`` is the share of the weights of the sources that are in the mix, which is what the others are
    renormalised to; ``deviation`` is how far the reached share is off, as a part of the due one (null where nothing is due)."""
    got = mixed.groupBy("mix_id", "source").agg(
        F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses")
    )
    weight = F.greatest(F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    want = targets.where("source is not null and mix_id is not null").groupBy("mix_id", "source").agg(F.sum(weight).alias("w"))
    of_mix = Window.partitionBy("mix_id")  # as many rows as the targets have
    part = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(of_mix).cast("double")), F.lit(0.0))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "uses", "most_uses")]
    there = F.when(F.col("tokens") > 0, F.col("w")).otherwise(F.lit(0.0)).alias("w_there")
    return (
        want.join(got, ["mix_id", "source"], "left").select("mix_id", "source", "w", *zero).select("*", there)
        .select("mix_id", "source", part("w").alias("target_share"), part("tokens").alias("reached_share"), "tokens", "documents", "uses", "most_uses", part("w_there").alias("due_share"))
        .withColumn("deviation", F.try_divide("reached_share", "due_share") - 1)
    )
