"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

Every live entry of a snapshot is an element: 128 bits of its key's hash and 64 bits of its content's. Elements fall
into buckets by key hash, and each bucket of a snapshot is a small table of cells that hold counts and XORs. The table
of one snapshot minus that of the one before it holds only the elements in which they differ; they are peeled out one
by one. A bucket that can't be peeled, or whose digest doesn't match what was peeled, is built again with more cells.
Recovered key hashes are classified by the signs of their elements.

Rows are moved once, by key hash, as hashes with the key's name; a bucket's tables are built where its rows then lie, so
no cell and no payload is ever moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.functions.hashing import np_xx64_longs

HASHES = 3
#: Rows of all snapshots that a bucket holds at least, if there are so many; it ends with the next key.
BUCKET_ROWS = 65_536
#: Cells of a bucket's first tables for each live key; a table can be peeled up to about 0.8 differences a cell.
FIRST_CELLS, GROWTH = 0.375, 4
#: Rows among which copies and older rows of a key fold before they are moved.
FOLD_ROWS = 65_536
#: Snapshots in one call; their ids are held by the driver.
MAX_SNAPSHOTS = 10_000
_BITS = ["k1", "k2", "v", "chk"]
KINDS = ["added", "removed", "changed"]


def _hash(cols: list[Column], salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *cols, *(c.isNull() for c in cols))


def _place(e: dict[str, np.ndarray], j: int, m: int) -> np.ndarray:
    return j * m + np.mod(np_xx64_longs(np.full(len(e["k1"]), j), e["k1"], e["k2"], e["v"]), m)


class Table:
    """Cells of a bucket of one snapshot, and the digest of all elements in it."""

    def __init__(self, m: int):
        self.m, self.digest = m, np.int64(0)
        self.cnt = np.zeros(HASHES * m, np.int64)
        self.xor = {c: np.zeros(HASHES * m, np.int64) for c in _BITS}

    def put(self, e: dict[str, np.ndarray], sign: np.ndarray | int = 1) -> None:
        for j in range(HASHES):
            at = _place(e, j, self.m)
            np.add.at(self.cnt, at, sign)
            for c in _BITS:
                np.bitwise_xor.at(self.xor[c], at, e[c])
        self.digest ^= _digest(e)

    def minus(self, other: Table) -> Table:
        out = Table(self.m)
        out.cnt, out.xor, out.digest = self.cnt - other.cnt, {c: self.xor[c] ^ other.xor[c] for c in _BITS}, self.digest ^ other.digest
        return out

    def peel(self) -> dict[str, np.ndarray] | None:
        """``k1, k2, v, chk`` and ``sign`` of every element of a subtracted table; None if it can't be emptied or doesn't add up. Empties the table."""
        found: list[dict] = []
        wanted = self.digest
        while True:
            pure = np.flatnonzero(np.abs(self.cnt) == 1)
            good = pure[check(*(self.xor[c][pure] for c in _BITS[:3])) == self.xor["chk"][pure]]
            if not len(good):
                break
            e = {c: self.xor[c][good] for c in _BITS} | {"sign": self.cnt[good]}
            _, first = np.unique(e["chk"], return_index=True)  # one that is left out is found in the next round
            e = {c: x[first] for c, x in e.items()}
            found.append(e)
            self.put(e, -e["sign"])
        if self.cnt.any() or any(x.any() for x in self.xor.values()):
            return None
        e = {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in [*_BITS, "sign"]}
        return e if _digest(e) == wanted else None


def check(k1: np.ndarray, k2: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np_xx64_longs(k1, k2, v)


def _digest(e: dict[str, np.ndarray]) -> np.int64:
    return np.bitwise_xor.reduce(np_xx64_longs(np.full(len(e["k1"]), 7), e["v"], e["k2"], e["k1"])) if len(e["k1"]) else np.int64(0)


def subtract(now: dict[str, np.ndarray], before: dict[str, np.ndarray], cells: float) -> dict[str, np.ndarray]:
    """The elements in which two sets of distinct elements differ, ``sign`` 1 for those of ``now``, by tables that grow until they can be peeled."""
    most = max(len(now["k1"]), len(before["k1"]))
    m = max(1, int(most * cells) // HASHES + 1)
    while True:
        a, b = Table(m), Table(m)
        a.put(now)
        b.put(before)
        got = a.minus(b).peel()
        if got is not None:
            return got
        if m > 8 * most + 64:  # there is no lack of room
            raise RuntimeError("snapshot buckets can't be peeled: hashes of different entries collide")
        m *= GROWTH


def _newest(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Of every key in every snapshot the place of the row that counts, in order of key hash."""
    c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("k1", "k2", "ord", "none", "t", "dead", "v")}
    order = np.lexsort((c["v"], c["dead"], c["t"], ~c["none"], c["ord"], c["k2"], c["k1"]))
    same = np.ones(len(order) - 1, bool)
    for n in ("k1", "k2", "ord"):
        x = c[n][order]
        same &= x[1:] == x[:-1]
    return order[np.append(~same, True)]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, FOLD_ROWS):
            part = b.slice(at, FOLD_ROWS)
            if part.num_rows:
                yield part.take(pa.array(_newest(part)))


def _changes(rows: pa.Table, cells: float) -> pa.RecordBatch:
    """``ord, key, kind`` of a bucket with all rows of its keys."""
    rows = rows.take(pa.array(_newest(rows))).combine_chunks()
    alive = np.flatnonzero(~rows.column("dead").to_numpy())
    ords = rows.column("ord").to_numpy()[alive]
    e = {c: rows.column(c).to_numpy()[alive] for c in _BITS[:3]}
    e["chk"] = check(*e.values())
    of = {int(o): np.flatnonzero(ords == o) for o in np.unique(ords)}
    none = np.zeros(0, np.int64)
    out = [[], [], []]
    for o in sorted({*of, *(o + 1 for o in of)}):
        if o == 0:
            continue
        now, before = of.get(o, none), of.get(o - 1, none)
        d = subtract({c: x[now] for c, x in e.items()}, {c: x[before] for c, x in e.items()}, cells)
        order = np.lexsort((d["sign"], d["k2"], d["k1"]))
        k1, k2, sign = (d[c][order] for c in ("k1", "k2", "sign"))
        pair = np.append((k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]), False) if len(k1) else np.zeros(0, bool)
        head = ~np.append(False, pair[:-1]) if len(k1) else pair
        kind = np.where(pair, 2, np.where(sign > 0, 0, 1))[head]
        k1, k2 = k1[head], k2[head]
        # The name of a recovered key: elements lie in order of key hash.
        have = np.concatenate([now, before])
        have = have[np.lexsort((e["k2"][have], e["k1"][have]))]
        at = np.searchsorted(e["k1"][have], k1)
        while (other := (e["k1"][have[at]] == k1) & (e["k2"][have[at]] != k2)).any():  # equal in the first half only
            at = np.where(other, at + 1, at)
        out[0].append(np.full(len(at), o))
        out[1].append(alive[have[at]])
        out[2].append(kind)
    ord_, place, kind = (np.concatenate(x) if x else none for x in out)
    return pa.record_batch([pa.array(ord_, pa.int32()), rows.column("key").combine_chunks().take(pa.array(place)), pa.array(KINDS).take(pa.array(kind))], names=["ord", "key", "kind"])


def snapshot_changes(
    snaps: DataFrame, snapshot: str = "snapshot_id", key: str = "key", clock: str = "ts", content: tuple[str, ...] = ("value",), tombstone: str = "tombstone",
    bucket_rows: int = BUCKET_ROWS, first_cells: float = FIRST_CELLS,
) -> DataFrame:
    """``snapshot_id, key, kind`` with kind ``added``, ``removed`` or ``changed``, for each snapshot against the delivered one before it.

    Within a snapshot the row of a key with the highest ``clock`` counts (null is lowest; of equal ones a tombstone,
    then the greatest content hash); the key is live if that row is no tombstone (null is none). ``changed``: live in
    both with another clock or content, null equal to null and different from empty. Snapshots are ordered by id;
    rows without one are left out. Fewer than two snapshots give no rows; so does no row at all.

    Two keys are told apart by 128 bits of hash, two contents of one key by 64. The table is read twice, once for the ids alone.
    Copies and older rows of a key fold among the rows of a task before they are moved, so a key that holds much of a
    snapshot is no hot spot. A task cuts its rows, sorted by key hash, into buckets of about ``bucket_rows`` and holds one at a time. A bucket that
    fails is enlarged until it has more than twice as many cells as elements, where peeling can't fail for lack of room. The driver
    is sent the list of snapshots.
    """
    ids = sorted(r[0] for r in snaps.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().limit(MAX_SNAPSHOTS + 1).collect())
    if len(ids) > MAX_SNAPSHOTS:
        raise ValueError(f"more than {MAX_SNAPSHOTS} snapshots; compare them in several calls")
    spark = snaps.sparkSession
    id_type, key_type = snaps.schema[snapshot].dataType.simpleString(), snaps.schema[key].dataType.simpleString()
    if len(ids) < 2:
        return spark.createDataFrame([], f"snapshot_id {id_type}, key {key_type}, kind string")
    what = [F.col(clock), *(F.col(c) for c in content)]
    at = F.unix_micros(F.col(clock)) if snaps.schema[clock].dataType.simpleString() == "timestamp" else F.col(clock).cast("long")
    rows = snaps.select(
        F.col(snapshot).alias("id"), F.col(key).alias("key"), _hash([F.col(key)], 1).alias("k1"), _hash([F.col(key)], 2).alias("k2"), F.col(clock).isNull().alias("none"),
        F.coalesce(at, F.lit(0)).alias("t"), F.coalesce(F.col(tombstone), F.lit(False)).alias("dead"), _hash(what, 3).alias("v"),
    )
    order = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], f"id {id_type}, ord int")
    rows = rows.join(F.broadcast(order), "id").drop("id")
    moved = rows.mapInArrow(_fold, rows.schema).repartition("k1", "k2").sortWithinPartitions("k1", "k2")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            start = 0
            k1, k2 = (b.column(c).to_numpy() for c in ("k1", "k2"))
            starts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1 if b.num_rows else np.zeros(0, int)
            if kept and b.num_rows and (kept[-1].column("k1")[-1].as_py(), kept[-1].column("k2")[-1].as_py()) != (int(k1[0]), int(k2[0])):
                starts = np.concatenate([[0], starts])
            for s in starts:
                if n + s - start >= bucket_rows:
                    kept.append(b.slice(start, s - start))
                    yield _changes(pa.Table.from_batches(kept), first_cells)
                    kept, n, start = [], 0, int(s)
            if b.num_rows > start:
                kept.append(b.slice(start))
                n += b.num_rows - start
        if kept:
            yield _changes(pa.Table.from_batches(kept), first_cells)

    found = moved.mapInArrow(scan, f"ord int, key {key_type}, kind string").where(F.col("ord") < len(ids))
    return found.join(F.broadcast(order), "ord").select(F.col("id").alias("snapshot_id"), "key", "kind")
