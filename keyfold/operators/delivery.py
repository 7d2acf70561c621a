"""Messages delivered more than once: a partitioned store of single winners with an identifier index.

The store keeps one row for each message in partitions by day of receipt and bucket of the identifier. A new batch is
looked up in an index of message identifiers, which names the historical partitions that hold copies of its messages;
only those are read, and of them only the messages in question are combined with the batch and reduced to one winner
each. Partitions that lose a winner are written anew, all others stay. A manifest that can be created only once per
version switches everything at the same moment.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyfold.session import cut
from keyfold.sources.files import create_once, list_names, make_dir, read_text

#: Columns of the store's own.
PART, ID, NEW, NAME = "__part", "__id", "__new", "__name"
#: More partitions than a driver should ever be told by name.
MAX_PARTITIONS = 100_000
#: Contested identifiers (a LONG each) up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Folders of the index; one more and they are written as one.
INDEX_FOLDERS = 16


class DeliveryStore:
    """``path`` holds ``manifest/``, ``data/``, ``index/`` and ``losers/``; all but the manifest is Parquet.

    ``identity``: the columns that make two deliveries one message, nulls equal. ``order``: the unique column whose
    smallest value wins; a delivery without one is an error. ``received``: the timestamp whose day, with one of ``buckets``
    buckets of the identifier, is the partition (null: day ``none``). ``buckets`` is fixed by the first merge; a partition
    should hold about a gigabyte.
    """

    def __init__(self, spark: SparkSession, path: str, identity: list[str], order: str, received: str, buckets: int = 4):
        self.spark, self.path = spark, path.rstrip("/")
        self.identity, self.order, self.received, self.buckets = identity, order, received, buckets
        make_dir(spark, f"{self.path}/manifest")

    def _manifest(self) -> tuple[int, dict]:
        names = [n for n in list_names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        if not names:
            return 0, {"parts": {}, "index": [], "losers": [], "schema": None, "buckets": self.buckets}
        return int(names[-1][1:-5]), json.loads(read_text(self.spark, f"{self.path}/manifest/{names[-1]}"))

    def _commit(self, version: int, body: dict) -> int:
        if not create_once(self.spark, f"{self.path}/manifest/v{version:012d}.json", json.dumps(body)):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def _with_place(self, rows: DataFrame, buckets: int) -> DataFrame:
        """``rows`` with their index entry and partition. Two messages with one entry only cost rows read in vain."""
        day = F.coalesce(F.date_format(F.col(self.received).cast("timestamp"), "yyyy-MM-dd"), F.lit("none"))
        entry = F.xxhash64(*self.identity, *(F.col(c).isNull() for c in self.identity))
        return rows.withColumn(ID, entry).withColumn(PART, F.concat(day, F.lit("."), F.pmod(ID, F.lit(buckets)).cast("string")))

    def _read(self, dirs: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, to: str) -> dict[str, str]:
        """Write ``rows``, which have PART, and return the folder of each partition."""
        rows.drop(ID).withColumnRenamed(PART, NAME).write.partitionBy(NAME).mode("overwrite").parquet(to)
        return {n.removeprefix(f"{NAME}="): f"{to}/{n}" for n in list_names(self.spark, to) if n.startswith(f"{NAME}=")}

    def merge(self, batch: DataFrame) -> int:
        """Take in a batch; returns the new version. A batch that is merged again changes nothing but the version.

        Copies of one message are found within the batch, across batches and in any order: a smaller ``order`` that
        arrives later takes the place of the winner in history, whose partition is written anew. Raises RuntimeError
        if another writer was faster; nothing of this merge is visible then.

        Of the whole batch and the index only identifiers (LONG) are shuffled. Contested are those that occur twice in the batch
        or are in the index; of these messages alone whole identities are compared. Each aggregation combines before its
        shuffle, so a message that makes up much of the batch is no hot spot. Payloads are read once, to be written.
        """
        version, m = self._manifest()
        new = version + 1
        buckets, size = m["buckets"], BROADCAST_IDS
        order = F.coalesce(F.col(self.order), F.raise_error(F.lit(f"a delivery has no {self.order}")))
        incoming = self._with_place(batch.withColumn(self.order, order), buckets)

        ids = incoming.groupBy(ID).agg(F.count("*").alias("n"))
        index = self._read(m["index"], f"{ID} long, {PART} string")
        contested = cut(ids.join(index, ID, "left").where((F.col("n") > 1) | F.col(PART).isNotNull()).select(ID, PART))
        named = contested.groupBy(PART).count().limit(MAX_PARTITIONS + 1).collect()
        if len(named) > MAX_PARTITIONS:
            raise ValueError(f"more than {MAX_PARTITIONS} partitions affected; use coarser partitions")
        few = lambda d: F.broadcast(d) if sum(r["count"] for r in named) <= size else d
        hot = contested.select(ID).distinct()
        affected = sorted(r[PART] for r in named if r[PART] in m["parts"])

        want = [*self.identity, self.order, PART]
        held = self._with_place(self._read([d for p in affected for d in m["parts"][p]], batch.schema), buckets)
        rows = incoming.join(few(hot), ID, "left_semi").select(*want, F.lit(True).alias(NEW))
        if affected:
            rows = rows.unionByName(held.join(few(hot), ID, "left_semi").select(*want, F.lit(False).alias(NEW)))
        best = rows.groupBy(*self.identity).agg(F.min(self.order).alias(self.order)).select(self.order, F.lit(True).alias("won"))
        each = rows.groupBy(self.order).agg(F.count_if(NEW).alias("times"), F.max(F.when(~F.col(NEW), F.col(PART))).alias(PART))
        verdict = cut(each.join(best, self.order, "left").select(self.order, "times", PART, F.coalesce("won", F.lit(False)).alias("won")))
        lost = ~F.col("won")
        displaced = verdict.where(lost & F.col(PART).isNotNull())
        changed = sorted(r[0] for r in displaced.select(PART).distinct().collect())

        # A delivery that history has already stays there, so that a batch which is merged again adds nothing.
        winners = verdict.where(F.col("won") & F.col(PART).isNull()).select(self.order, "times")
        flagged = incoming.join(few(hot.withColumn("__hot", F.lit(True))), ID, "left").join(few(winners), self.order, "left")
        fresh = flagged.where(F.col("__hot").isNull() | (F.col("times") == 1)).select(*incoming.columns)
        if not winners.where("times > 1").isEmpty():
            fresh = fresh.unionByName(flagged.where("times > 1").dropDuplicates([self.order]).select(*incoming.columns))
        losers = f"{self.path}/losers/v{new}"
        verdict.where(lost).select(self.order).write.mode("overwrite").parquet(losers)
        wrote = self._write(fresh, f"{self.path}/data/v{new}")
        parts = {p: d for p, d in m["parts"].items() if p not in changed}
        if changed:
            old = self._with_place(self._read([d for p in changed for d in m["parts"][p]], batch.schema), buckets)
            for p, d in self._write(old.join(few(displaced), self.order, "left_anti"), f"{self.path}/data/v{new}-kept").items():
                parts[p] = [d]
        for p, d in wrote.items():
            parts[p] = [*parts.get(p, []), d]
        entries = self._with_place(self._read(list(wrote.values()), batch.schema), buckets).select(ID, PART)
        known = m["index"]
        if len(known) >= INDEX_FOLDERS:
            entries, known = entries.unionByName(index), []
        entries.write.mode("overwrite").parquet(f"{self.path}/index/v{new}")
        return self._commit(new, {
            "parts": parts, "index": [*known, f"{self.path}/index/v{new}"], "losers": [*m["losers"], losers], "schema": batch.schema.json(), "buckets": buckets,
            "affected": affected, "rewrote": changed,
        })

    def compact(self) -> int:
        """Give each partition one folder and the index one folder of what is current; returns the new version.

        Readers of older versions keep what they opened; folders that no version names can be deleted at leisure."""
        version, m = self._manifest()
        rows = self.current()
        if rows is None:
            return version
        new = version + 1
        placed = self._with_place(rows, m["buckets"])
        wrote = self._write(placed.repartition(PART, F.pmod(F.xxhash64(self.order), F.lit(8))), f"{self.path}/data/v{new}")
        placed.select(ID, PART).write.mode("overwrite").parquet(f"{self.path}/index/v{new}")
        self.duplicates().write.mode("overwrite").parquet(f"{self.path}/losers/v{new}")
        return self._commit(new, m | {
            "parts": {p: [d] for p, d in wrote.items()}, "index": [f"{self.path}/index/v{new}"], "losers": [f"{self.path}/losers/v{new}"], "affected": [], "rewrote": sorted(wrote),
        })

    def current(self) -> DataFrame | None:
        """One row for each message, or None while nothing was merged."""
        _, m = self._manifest()
        return self._read([d for ds in m["parts"].values() for d in ds], StructType.fromJson(json.loads(m["schema"]))) if m["schema"] else None

    def duplicates(self) -> DataFrame | None:
        """``order`` of every delivery that lost against another copy of its message."""
        _, m = self._manifest()
        if not m["losers"]:
            return None
        schema = StructType([f for f in StructType.fromJson(json.loads(m["schema"])) if f.name == self.order])
        return self.spark.read.schema(schema).parquet(*m["losers"]).distinct()

    def affected(self) -> list[str]:
        """Partitions that the last merge looked into."""
        return self._manifest()[1].get("affected", [])

    def rewritten(self) -> list[str]:
        """Partitions that the last merge replaced."""
        return self._manifest()[1].get("rewrote", [])


def in_batches(df: DataFrame, order: str, batches: int, path: str) -> list[DataFrame]:
    """``df`` cut into consecutive ranges of ``order`` of about one size, each a folder of its own below ``path``.

    Together they hold every row once; rows without an ``order`` come first. The input is read once for the cuts, of which only the column
    ``order``, and once to write the folders; each batch afterwards reads no more than itself.
    """
    q = df.agg(F.percentile_approx(order, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(q or []))
    number = sum(((F.col(order) > c).cast("int") for c in cuts), F.lit(0))
    df.withColumn(NAME, F.coalesce(number, F.lit(0))).write.partitionBy(NAME).mode("overwrite").parquet(path)
    names = [n for n in list_names(df.sparkSession, path) if n.startswith(f"{NAME}=")]
    return [df.sparkSession.read.schema(df.schema).parquet(f"{path}/{n}") for n in sorted(names, key=lambda n: int(n.removeprefix(f"{NAME}=")))]
