"""Current state of a table from a stream of inserts, updates and deletes, resolved from the newest change back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keyfold.functions.hashing import item_hash, key_hash, unsigned_order
from keyfold.session import shared_path
from keyfold.sources.files import delete, list_names

BATCH = "__batch"
#: Resolved keys up to this size are broadcast, a key counting KEY_ROOM bytes besides its own.
BROADCAST_BYTES, KEY_ROOM = 16 << 20, 32


def change_order(family: str = "xxh64") -> Column:
    """The project's order of changes: clock, node id by bytes (null is the empty id), item hash unsigned."""
    h = item_hash(key_hash(F.col("key"), family), F.col("ts"), F.col("node_id"), F.col("value"), F.col("op") == "del", family)
    return F.struct(F.col("ts").alias("ts"), F.coalesce("node_id", F.lit("")).alias("node"), unsigned_order(h).alias("hash"))


def batch_bounds(log: DataFrame, batches: int) -> list[int]:
    """Up to ``batches - 1`` clock values that cut the log into batches of about one size."""
    if batches < 2:
        return []
    q = [i / batches for i in range(1, batches)]
    found = log.agg(F.percentile_approx("ts", q, 1000)).first()[0] or []
    return sorted(set(found))


def _split() -> list[Column]:
    """The key as two columns that are never null, so that joins on them need no null-safe equality."""
    return [F.coalesce("key", F.lit("")).alias("__k"), F.col("key").isNull().alias("__none")]


def _image(payload: tuple[str, ...], source: str, seq: Column, family: str) -> Column:
    """A change or base row as a struct that compares by the project's order, of equal ones by the smallest ``seq``."""
    order = F.struct(change_order(family).alias("o"), (-seq).alias("s"))
    return F.struct(order.alias("rank"), F.struct(*payload).alias("payload"), F.lit(source).alias("source")).alias("w")


def newest_of(rows: DataFrame) -> DataFrame:
    """The greatest image of each key; folds before its shuffle."""
    return rows.groupBy("__k", "__none").agg(F.max("w").alias("w"))


def unresolved(rows: DataFrame, resolved: DataFrame | None, small: bool) -> DataFrame:
    """The newest image of each key of ``rows`` that isn't ``resolved``.

    ``small``: the resolved keys are known to be few enough to be sent to every task; rows of these keys then vanish where they are
    read, before anything is hashed, folded or moved. Beyond that rows fold first, as those of a hot key must not be gathered for a join.
    """
    if resolved is None:
        return newest_of(rows)
    keys = resolved.select("__k", "__none")
    if small:
        return newest_of(rows.join(F.broadcast(keys), ["__k", "__none"], "left_anti"))
    return newest_of(rows).join(keys, ["__k", "__none"], "left_anti")


def resolve(
    log: DataFrame, base: DataFrame | None = None, batches: int = 3, payload: tuple[str, ...] = ("op", "value", "node_id"), family: str = "xxh64",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The winning change of every key: ``key, ts, seq`` and ``payload``, with ``source`` (``change`` or ``base``).

    ``log`` has ``seq, op, key, value, ts, node_id``; a ``del`` wins as a tombstone. The log is cut once into batches by its
    clock, each a folder in the shared folder, so every change of a later batch beats every change of an earlier one, however late or
    often it arrived. Batches are resolved backwards: in the newest one each key gets its greatest change, of equal ones that with the
    smallest ``seq``; each older one drops what a newer one resolved, by an anti-join, and resolves the rest. First-seen images and
    tombstones are written batch by batch. Last, rows of ``base`` (same columns but ``seq``) whose key no change touched are appended as
    they are; those of touched keys are compared with the image, as a change can be older than the base.

    The log is read twice: the clock alone for the cuts, and once to write the batches, each of which is read once. Keys resolved so far
    are broadcast while they take up to ``broadcast_bytes``; then neither rows of resolved keys nor the untouched base are moved at all.
    One row a key takes part in other joins, so a hot key costs nothing there. A null key is a key; changes without a clock or with an
    unknown ``op`` lose to nothing and are left out. An empty log gives the base.
    """
    spark = log.sparkSession
    useful = log.where(F.col("ts").isNotNull() & F.col("op").isin("set", "del"))
    number = sum(((F.col("ts") <= b).cast("int") for b in batch_bounds(log.select("ts"), batches)), F.lit(0))
    staged = useful.select(*_split(), _image(payload, "change", F.col("seq"), family), number.alias(BATCH))
    schema = staged.drop(BATCH).schema
    cuts, out = shared_path(spark, "batches"), shared_path(spark, "resolved")
    staged.write.partitionBy(BATCH).parquet(cuts)
    done: list[str] = []
    size = 0
    for n in sorted(int(x.removeprefix(f"{BATCH}=")) for x in list_names(spark, cuts) if x.startswith(f"{BATCH}=")):
        rows = spark.read.schema(schema).parquet(f"{cuts}/{BATCH}={n}")
        seen = Observation()
        found = unresolved(rows, spark.read.schema(schema).parquet(*done) if done else None, size <= broadcast_bytes)
        found.observe(seen, F.coalesce(F.sum(F.octet_length("__k") + KEY_ROOM), F.lit(0)).alias("bytes")).write.parquet(f"{out}/{n}")
        size += seen.get["bytes"]
        done.append(f"{out}/{n}")
    delete(spark, cuts)
    winners = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    if base is not None:
        keys = winners.select("__k", "__none")
        keys = F.broadcast(keys) if size <= broadcast_bytes else keys
        rows = base.select(*_split(), _image(payload, "base", F.lit(None).cast("long"), family))
        touched = rows.join(keys, ["__k", "__none"], "left_semi")
        winners = newest_of(winners.unionByName(touched)).unionByName(rows.join(keys, ["__k", "__none"], "left_anti"))
    return winners.select(
        F.when(~F.col("__none"), F.col("__k")).alias("key"), F.col("w.rank.o.ts").alias("ts"), (-F.col("w.rank.s")).alias("seq"),
        *(F.col("w.payload")[p].alias(p) for p in payload), F.col("w.source").alias("source"),
    )


def live(winners: DataFrame) -> DataFrame:
    """Winners that are no tombstones."""
    return winners.where(F.col("op") == "set")
