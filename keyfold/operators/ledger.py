"""Processing only new or changed records: a work-item ledger with leases and fencing tokens.

An item is a window ``(lo, hi]`` of arrival times. It is *pending* until an attempt leases it, *leased* until the
attempt reports or its lease runs out, and *done* for good once an attempt with the current token completes it.
Tokens rise with every lease, so a writer that lost its lease can't complete anything. Each item and token has one
output path, which a retry overwrites and which readers see only through the ledger.

``WorkLedger`` keeps the ledger in a shared folder, ``process_new`` processes what has landed since the last item through it.
``replay`` folds a finished history of attempts into items with DataFrame operators: each attempt leases all that is open under
the next token, whatever held it before. ``changes_by_run`` joins the two: the changes of a log are processed item by item through a
live ledger, and what an item writes are its changes with the attempts that a history says completed them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.session import cut, shared_path
from keyfold.sources.files import create_once, list_names, make_dir, read_text

#: Slices of time in which the history is ordered; only one row of each slice meets the others in one task.
MAX_SLICES = 4096


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def attempts(runs: DataFrame) -> DataFrame:
    """Distinct attempts of a run ledger: ``run_id, attempt, at, ok, outcome``.

    Repeated ledger rows count once, an attempt that was ever reported ``ok`` is ok. ``outcome`` is the transition it
    causes: ``done``; ``returned`` for a reported failure; ``expired`` where it never reported, so that the lease had
    to run out. Attempts without a start can't have seen anything and are left out.
    """
    status = F.lower(F.trim("status"))
    return (
        runs.select("run_id", "attempt", micros(F.col("started_at")).alias("at"), status.alias("status"))
        .where("at is not null")
        .groupBy("run_id", "attempt", "at")
        .agg(F.coalesce(F.max(F.col("status") == "ok"), F.lit(False)).alias("ok"), F.max("status").alias("said"))
        .select("run_id", "attempt", "at", "ok", F.when(F.col("ok"), "done").when(F.col("said").isNull(), "expired").otherwise("returned").alias("outcome"))
    )


def replay(runs: DataFrame) -> DataFrame:
    """Fold the history of a ledger into its work items.

    One row per window between the starts of two attempts: ``lo`` (exclusive; null: from the beginning), ``hi``
    (inclusive), ``state`` (``done`` or ``pending``), the ``run_id`` and ``attempt`` that completed it, the fencing
    ``token`` it was completed under, and ``leases``, how often it was leased up to then (pending: so far). Every attempt
    takes the next token, so ``first_token`` is that of the item's first lease. Times are microseconds.
    An attempt leases every open item with ``hi`` up to its start; only an ok one completes them, so the item goes to
    the earliest ok attempt that started at or after ``hi``. Of attempts with one start the ok one counts, then the
    one with the smallest ``run_id`` and ``attempt``. An empty ledger gives no items.

    Windows run within slices of time; between slices goes one row per slice, MAX_SLICES at most.
    """
    a = attempts(runs)
    lo, hi, n = a.agg(F.min("at"), F.max("at"), F.count("*")).first()
    slices = max(1, min(MAX_SLICES, (n or 0) // 2048))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // slices))
    a = (
        a.groupBy("at")  # of one start only one attempt can hold the token
        .agg(F.min(F.struct(~F.col("ok"), "run_id", "attempt", "outcome")).alias("w"))
        .select("at", F.expr("(at - {}) div {}".format(lo or 0, width)).alias("slice"), "w.run_id", "w.attempt", (F.col("w.outcome") == "done").alias("ok"))
    )
    w = Window.partitionBy("slice").orderBy("at")
    a = a.withColumn("rank", F.row_number().over(w))
    per = a.groupBy("slice").agg(
        F.count("*").alias("n"),
        F.max("at").alias("last_at"),
        F.count_if("ok").alias("n_ok"),
        F.min(F.when(F.col("ok"), F.struct("at", "run_id", "attempt", "rank"))).alias("first_ok"),
    )
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    per = per.withColumn("rank0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per = per.withColumn("first_ok", F.when(F.col("first_ok").isNotNull(), F.struct("first_ok.at", "first_ok.run_id", "first_ok.attempt", (F.col("rank0") + F.col("first_ok.rank")).alias("token"))))
    per = per.select(
        "slice",
        "rank0",
        F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
        F.last("last_at", True).over(before).alias("prev_at0"),
        F.first("first_ok", True).over(after).alias("next_ok0"),
    )
    down = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    b = a.join(per, "slice").withColumn("token", F.col("rank0") + F.col("rank"))
    ok_row = F.when(F.col("ok"), F.struct("at", "run_id", "attempt", "token"))
    b = b.select("*", F.lag("at").over(w).alias("prev_at"), F.first(ok_row, True).over(down).alias("next_ok"))
    nxt = F.coalesce("next_ok", "next_ok0")
    return b.select(
        F.coalesce("prev_at", "prev_at0").alias("lo"),
        F.col("at").alias("hi"),
        F.when(nxt.isNotNull(), "done").otherwise("pending").alias("state"),
        nxt["run_id"].alias("run_id"),
        nxt["attempt"].alias("attempt"),
        nxt["at"].alias("done_at"),
        F.col("token").alias("first_token"),
        nxt["token"].alias("token"),
        (F.coalesce(nxt["token"], "all") - F.col("token") + 1).alias("leases"),
    )


def locate(points: DataFrame, at: str, windows: DataFrame, carry: list[str]) -> DataFrame:
    """``points`` with the ``carry`` columns of the one window ``(lo, hi]`` that holds ``at``; others fall away.

    An equi-join on cells of time: cells are so wide that there are about four to a window, and a window is listed
    under each cell that it touches, which makes five rows a window in all. Spark broadcasts the list only below its
    own threshold and splits cells that hold very many points.
    """
    lo, hi, n = windows.agg(F.min("hi"), F.max("hi"), F.count("*")).first()
    if not n:
        return points.join(windows.select(*carry), F.lit(False), "inner")
    cell = max(1, (hi - lo) // (4 * n))
    of = lambda c: F.expr(f"greatest(({c} - {lo}) div {cell}, -1L)")  # noqa: E731  # all before the first end are cell -1
    listed = windows.select(
        F.coalesce("lo", F.lit(-(1 << 63)).cast("long")).alias("__lo"), F.col("hi").alias("__hi"), *carry
    ).select("*", F.explode(F.sequence(F.when(F.col("__lo") < lo, F.lit(-1).cast("long")).otherwise(of("__lo")), of("__hi"))).alias("__cell"))
    return (
        points.where((F.col(at) <= hi))
        .withColumn("__cell", F.when(F.col(at) < lo, F.lit(-1).cast("long")).otherwise(of(at)))
        .join(listed, "__cell")
        .where((F.col(at) > F.col("__lo")) & (F.col(at) <= F.col("__hi")))
        .drop("__cell", "__lo", "__hi")
    )


@dataclass(frozen=True)
class Lease:
    item: str
    lo: int | None
    hi: int
    token: int
    until: float


class StaleToken(RuntimeError):
    """The lease behind a write has run out or the item has gone to another worker."""


class WorkLedger:
    """A live ledger in a folder that all workers share.

    Every transition is one numbered file which can be created only once, so two workers that act on the same state
    can't both succeed; the loser reads the new state and tries again. Every ``compact_every`` transitions the state
    is folded into one file, and what was done since the fold before into another, which is never read again but by ``outputs``.
    A transition reads and holds open items, and done ones since the last fold.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 64):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every
        make_dir(spark, self.path)

    def _read(self, name: str) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/{name}"))

    def _create(self, name: str, body: dict) -> bool:
        """False where the file is already there. The file appears whole or not at all."""
        return create_once(self.spark, f"{self.path}/{name}", json.dumps(body))

    def _state(self) -> tuple[int, dict]:
        names = list_names(self.spark, self.path)
        folds = [n for n in names if n.startswith("state-") and n.endswith(".json")]
        at, state = -1, {"items": {}, "token": 0, "mark": None}
        if folds:
            state, at = self._read(folds[-1]), int(folds[-1][6:18])
        state["done"] = {}
        for n in names:
            if n.startswith("event-") and n.endswith(".json") and int(n[6:18]) == at + 1:
                self._apply(state, self._read(n))
                at += 1
        return at, state

    @staticmethod
    def _apply(state: dict, e: dict) -> None:
        items = state["items"]
        if e["kind"] == "add":
            items[e["item"]] = {"lo": e["lo"], "hi": e["hi"], "state": "pending", "token": 0, "until": 0.0, "leases": 0}
            state["mark"] = e["hi"]
        elif e["kind"] == "lease":
            items[e["item"]].update(state="leased", token=e["token"], until=e["until"], leases=items[e["item"]]["leases"] + 1)
            state["token"] = e["token"]
        elif e["kind"] == "return":
            items[e["item"]].update(state="pending")
        elif e["kind"] == "done":
            items.pop(e["item"])
            state["done"][e["item"]] = {"token": e["token"], "output": e["output"]}

    def _transact(self, decide: Callable[[dict], dict | None]) -> dict | None:
        """Append the event that ``decide`` makes of the newest state, again until nobody was faster."""
        while True:
            at, state = self._state()
            event = decide(state)
            if event is None:
                return None
            if self._create(f"event-{at + 1:012d}.json", event):
                self._apply(state, event)
                if (at + 2) % self.compact_every == 0:
                    self._create(f"closed-{at + 1:012d}.json", state["done"])  # first, so that a fold never hides an output
                    self._create(f"state-{at + 1:012d}.json", {k: v for k, v in state.items() if k != "done"})
                return event
            time.sleep(0.05)

    def add(self, hi: int) -> str | None:
        """A pending item from the end of the last one up to ``hi``; None where there is nothing new."""

        def decide(s: dict) -> dict | None:
            if s["mark"] is not None and hi <= s["mark"]:
                return None
            return {"kind": "add", "item": f"{'start' if s['mark'] is None else s['mark']}_{hi}", "lo": s["mark"], "hi": hi}

        e = self._transact(decide)
        return e and e["item"]

    def lease(self, ttl: float, now: float | None = None) -> Lease | None:
        """The oldest item that is pending or whose lease has run out, under a new token."""
        now = time.time() if now is None else now

        def decide(s: dict) -> dict | None:
            free = [(i["hi"], k) for k, i in s["items"].items() if i["state"] == "pending" or i["until"] <= now]
            return {"kind": "lease", "item": sorted(free)[0][1], "token": s["token"] + 1, "until": now + ttl} if free else None

        e = self._transact(decide)
        if e is None:
            return None
        i = self._state()[1]["items"][e["item"]]
        return Lease(e["item"], i["lo"], i["hi"], e["token"], e["until"])

    def _held(self, s: dict, lease: Lease, now: float) -> None:
        i = s["items"].get(lease.item)
        if i is None or i["state"] != "leased" or i["token"] != lease.token or i["until"] <= now:
            raise StaleToken(f"{lease.item}: token {lease.token} is no longer current")

    def complete(self, lease: Lease, output: str, now: float | None = None) -> None:
        """Mark the item done; raises StaleToken if the lease has run out or was given to another worker."""
        now = time.time() if now is None else now

        def decide(s: dict) -> dict:
            self._held(s, lease, now)
            return {"kind": "done", "item": lease.item, "token": lease.token, "output": output}

        self._transact(decide)

    def give_back(self, lease: Lease, now: float | None = None) -> None:
        """Return a leased item to pending after a failure that was noticed."""
        now = time.time() if now is None else now

        def decide(s: dict) -> dict:
            self._held(s, lease, now)
            return {"kind": "return", "item": lease.item}

        self._transact(decide)

    def _done(self) -> dict[str, dict]:
        """Done items in the order of their windows."""
        done = self._state()[1]["done"]
        for n in list_names(self.spark, self.path):
            if n.startswith("closed-") and n.endswith(".json"):
                done = self._read(n) | done
        return dict(sorted(done.items(), key=lambda x: int(x[0].split("_")[1])))

    def states(self, now: float | None = None) -> dict[str, str]:
        now = time.time() if now is None else now
        _, s = self._state()
        open_ = {k: "pending" if i["state"] == "leased" and i["until"] <= now else i["state"] for k, i in s["items"].items()}
        return {**{k: "done" for k in self._done()}, **open_}

    def outputs(self) -> list[str]:
        """Paths of the done items, the only ones that readers may open."""
        return [d["output"] for d in self._done().values()]


#: Halves of the identity of a change: 128 bits of hash.
CHANGE = ["change_hi", "change_lo"]


def with_identity(rows: DataFrame, identity: list[str]) -> DataFrame:
    """``rows`` with CHANGE, equal for rows equal in ``identity``; nulls are equal, and an empty value differs from null."""
    parts = [*identity, *(F.col(c).isNull() for c in identity)]
    return rows.withColumns({c: F.xxhash64(F.lit(i), *parts) for i, c in enumerate(CHANGE)})


def process_new(
    ledger: WorkLedger, source: DataFrame, landed: str, sink: str, work: Callable[[DataFrame], DataFrame], ttl: float = 3600, now: float | None = None,
    upto: int | None = None, identity: list[str] | None = None, order: str | None = None,
) -> list[str]:
    """Process what has landed in ``source`` since the last completed item; returns the outputs written.

    The new item ends at ``upto`` (microseconds), through which the source must be complete; by default right before the newest arrival
    that is visible, as more rows may come with that very time. Rows without an arrival are in no item.

    ``work`` gets the rows of one item. With ``identity``, rows equal in these columns are one change, which arrives as often as it likes
    and is handed out once: ``work`` gets ``order``, the least of the copies, its ``landed`` and CHANGE, which its result must keep; changes that a done
    item has put out are left out. Copies fold before they are moved.

    A failure gives the item back and is raised; a crash leaves a lease that runs out. Either way the next call processes
    exactly the open windows. An output lies under its item and token; where the lease ran out on the way it stays unseen, and
    StaleToken is raised.
    """
    t = F.col(landed) if dict(source.dtypes)[landed] == "timestamp" else F.col(landed).cast("timestamp")
    if upto is None:
        newest = source.select(F.max(micros(t))).first()[0]
        upto = None if newest is None else newest - 1
    if upto is not None:
        ledger.add(upto)
    wrote = []
    while lease := ledger.lease(ttl, now):
        rows = source.where((t <= F.timestamp_micros(F.lit(lease.hi))) & (F.lit(True) if lease.lo is None else t > F.timestamp_micros(F.lit(lease.lo))))
        out = f"{sink.rstrip('/')}/item={lease.item}/token={lease.token}"
        try:
            if identity:
                rows = with_identity(rows, identity).groupBy(*CHANGE).agg(F.min(order).alias(order), F.min(landed).alias(landed))
                if known := ledger.outputs():
                    rows = rows.join(ledger.spark.read.parquet(*known).select(*CHANGE), CHANGE, "left_anti")
            work(rows).write.mode("overwrite").parquet(out)
        except Exception:
            try:
                ledger.give_back(lease, now)
            except StaleToken:
                pass  # somebody else has the item; what went wrong here is raised all the same
            raise
        ledger.complete(lease, out, now)
        wrote.append(out)
    return wrote


def changes_by_run(log: DataFrame, runs: DataFrame, identity: list[str], seq: str = "seq", landed: str = "landed_at", items: int = 3) -> DataFrame:
    """``run_id, attempt, seq``: every change of ``log`` under the run that has to process it.

    Rows equal in ``identity`` (nulls equal, an empty value different from null) are one change, which lands with its
    smallest ``seq``; arrival never falls as ``seq`` grows. The history ``runs`` says which windows were done by which attempt (``replay``).
    The log is processed through a live ledger in as many ``items``, which end with windows of the history: each is leased, reads its own stretch of the
    log, leaves out changes of items done before, and writes the rest with their attempts under its item and token; the result
    is read from the outputs of done items. Changes of pending windows, after the last window, and those that never
    landed, have no row. Copies are folded before anything is moved; of the log only 128 bits a change are. Extra columns are not read.
    """
    spark = log.sparkSession
    windows = cut(replay(runs).where("state = 'done'").select("lo", "hi", "run_id", "attempt"))
    ends = windows.agg(F.percentile_approx("hi", [(i + 1) / items for i in range(items)], 1000)).first()[0]
    schema = "run_id {}, attempt {}, {} {}".format(*(dict(d.dtypes)[c] for d, c in ((runs, "run_id"), (runs, "attempt"))), seq, dict(log.dtypes)[seq])
    if not ends:
        return spark.createDataFrame([], schema)
    ledger, sink = WorkLedger(spark, shared_path(spark, "ledger")), shared_path(spark, "changes")

    def attempts_of(rows: DataFrame) -> DataFrame:
        found = locate(rows.withColumn("__at", micros(F.col(landed))), "__at", windows, ["run_id", "attempt"])
        return found.select("run_id", "attempt", seq, *CHANGE)

    for end in sorted(set(ends)):
        process_new(ledger, log.select(*{*identity, seq, landed}), landed, sink, attempts_of, upto=end, identity=identity, order=seq)
    return spark.read.schema(schema).parquet(*ledger.outputs())
