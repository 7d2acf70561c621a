"""Hybrid logical clock: milliseconds in the upper 48 bits, a counter in the lower 16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.operators.running import bounds_of, running
from keyfold.session import cut

BITS = 16
MASK = (1 << BITS) - 1
MAX_MS = ((1 << 63) - 1) >> BITS
MAX_TS = (1 << 63) - 1
#: A remote clock that is further ahead than this many milliseconds is not believed.
DRIFT_MS = 5000


def clamp_ms(ms: Column) -> Column:
    return F.least(F.greatest(ms, F.lit(0).cast("long")), F.lit(MAX_MS).cast("long"))


def pack(ms: Column, logical: Column) -> Column:
    return F.shiftleft(clamp_ms(ms.cast("long")), BITS).bitwiseOR(logical.cast("long").bitwiseAND(F.lit(MASK).cast("long")))


def ms_of(ts: Column) -> Column:
    return F.shiftrightunsigned(ts, BITS)


def logical_of(ts: Column) -> Column:
    return ts.bitwiseAND(F.lit(MASK).cast("long")).cast("int")


def time_of(ts: Column) -> Column:
    return F.timestamp_millis(ms_of(ts))


def believed(remote: Column, now_ms: Column) -> Column:
    """Whether a remote timestamp moves the local clock. The write that carries it is applied either way."""
    return remote.isNotNull() & (remote >= 0) & (ms_of(remote) <= now_ms + DRIFT_MS)


def now_sequence(samples: DataFrame) -> DataFrame:
    """``samples`` (``node_id, seq, ms``: readings of the wall clock in order) with ``ts``, the stamps that a clock gives.

    The greatest reading so far is the physical part; readings under the same one are counted. A counter that is
    exhausted goes on in the next millisecond; a clock at its ceiling stays there. Neither step sorts more than a
    slice of a node in one task.
    """
    s = samples.where("seq is not null").withColumn("ms", clamp_ms(F.coalesce("ms", F.lit(0).cast("long"))))
    b = bounds_of(s, "seq")
    p = cut(running(s, ["node_id"], "seq", F.col("ms"), "__p", F.max, inclusive=True, bounds=b))  # it is used twice
    # Within a node the greatest reading never falls, so its equal values are one stretch of seq.
    n = running(p, ["node_id", "__p"], "seq", F.lit(1).cast("long"), "__n", F.sum, bounds=b)
    stamp = F.when(F.col("__p") >= MAX_MS, F.lit(MAX_TS).cast("long")).otherwise(F.shiftleft("__p", BITS) + F.coalesce("__n", F.lit(0).cast("long")))
    return n.withColumn("ts", stamp).drop("__p", "__n")


def after_update(state: int, remote: int | None, now_ms: int) -> int:
    """State of a clock after it took in ``remote`` while the wall clock read ``now_ms``."""
    if remote is None or remote < 0 or remote >> BITS > max(now_ms, 0) + DRIFT_MS:
        return state
    if state >> BITS >= MAX_MS:
        return state
    wall = min(max(now_ms, 0), MAX_MS) << BITS
    top = max(state >> BITS, remote >> BITS, wall >> BITS) << BITS
    counters = [v & MASK for v in (state, remote) if v >> BITS == top >> BITS]
    # A carry out of the counter is the next millisecond.
    return top + max(counters) + 1 if counters else top


def after_now(state: int, now_ms: int) -> int:
    if state >> BITS >= MAX_MS:
        return MAX_TS
    wall = min(max(now_ms, 0), MAX_MS) << BITS
    return wall if wall >> BITS > state >> BITS else state + 1


def run_clock(events: DataFrame) -> DataFrame:
    """``node_id, seq, ts``: the state of each node's clock after each event in order.

    ``events``: ``node_id, seq, ms`` (wall clock, null is 0) and ``remote`` (null: the node stamps a write of its own). An event
    takes a clock from ``s`` to ``max(s + 1, c)``, where ``c`` is the wall clock or the remote stamp plus 1, whichever is greater; one
    whose remote stamp isn't believed changes nothing. After ``k`` steps the state therefore is ``k`` plus the greatest
    ``c - k`` up to there, so two running aggregates do it, without a node ever being gathered in one task.
    A clock at its ceiling stays there.
    """
    wall = clamp_ms(F.coalesce("ms", F.lit(0)).cast("long"))
    own = F.col("remote").isNull()
    step = own | believed(F.col("remote"), wall)
    top = F.greatest(F.shiftleft(wall, BITS), F.when(~own & (F.col("remote") < MAX_TS), F.col("remote") + 1))
    e = events.select("node_id", "seq", step.alias("__step"), top.alias("__c")).where("seq is not null")
    b = bounds_of(e, "seq")
    k = cut(running(e, ["node_id"], "seq", F.col("__step").cast("long"), "__k", F.sum, inclusive=True, bounds=b))  # it is used twice
    m = running(k, ["node_id"], "seq", F.when(F.col("__step"), F.col("__c") - F.col("__k")), "__m", F.max, inclusive=True, bounds=b)
    best = F.greatest(F.coalesce("__m", F.lit(0).cast("long")), F.lit(0).cast("long"))
    ceiling = F.lit(MAX_TS).cast("long")
    return m.select("node_id", "seq", F.when(best > ceiling - F.col("__k"), ceiling).otherwise(best + F.col("__k")).alias("ts"))
