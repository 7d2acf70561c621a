"""Queries of the change-processing operators over the tables of the test data, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators import celldiff, delivery, fold, ledger, newest, snapdiff
from keyfold.plans.state import CUT, LOG_WITH_HASHES
from keyfold.session import shared_path, table
from keyfold.sources.files import delete

CHANGE = ["op", "key", "ts", "node_id", "value"]
MESSAGE = ["replica", "op", "key", "ts", "node_id"]
FIELDS = ["value", "ts", "node_id", "tombstone"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.changes_by_run(table(spark, d, "mutations"), table(spark, d, "sync_runs"), CHANGE).select("run_id", "seq")


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    """Work items of the replayed ledger."""
    t = lambda c: F.timestamp_micros(c).alias(c)
    items = ledger.replay(table(spark, d, "sync_runs"))
    return items.select(t("lo"), t("hi"), "state", "run_id", "attempt", "first_token")


def p1_leases(spark: SparkSession, d: str) -> DataFrame:
    """Under which token each work item was completed, and how often it had been leased up to then."""
    items = ledger.replay(table(spark, d, "sync_runs"))
    return items.select(F.timestamp_micros("hi").alias("hi"), "token", "leases")


def p1_run_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Changes that each completing run had to process."""
    found = ledger.changes_by_run(table(spark, d, "mutations"), table(spark, d, "sync_runs"), CHANGE)
    return found.groupBy("run_id").agg(F.count("*").alias("changes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return celldiff.copy_differences(table(spark, d, "replica_a"), table(spark, d, "replica_b"), "key", FIELDS)


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    return celldiff.difference_summary(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return newest.live(newest.resolve(table(spark, d, "mutations"), payload=("op",))).select("key", "seq")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the rebuilt table, tombstones included."""
    w = newest.resolve(table(spark, d, "mutations"))
    return w.select("key", "value", "ts", "node_id", (F.col("op") == "del").alias("tombstone"))


def p3_state_sha64(spark: SparkSession, d: str) -> DataFrame:
    """The same with ties broken by the hash family that SQL can repeat."""
    w = newest.resolve(table(spark, d, "mutations"), payload=("op",), family="sha64")
    return w.select("key", "seq", "ts", "op")


def p3_onto_base(spark: SparkSession, d: str) -> DataFrame:
    """The same from the state at a cut, to which the changes that landed after it are applied, some of them older than the state."""
    log = table(spark, d, "mutations")
    late = F.coalesce(F.col("landed_at") >= F.lit(CUT).cast("timestamp"), F.lit(True))
    state = fold.fold(fold.as_entries(log.where(~late)), "sha64")
    base = state.select("key", "ts", F.when(F.col("tombstone"), "del").otherwise("set").alias("op"), "value", "node_id")
    return newest.resolve(log.where(late), base, family="sha64").select("key", "ts", "op")


def _delivered(spark: SparkSession, d: str, batches: int = 4) -> delivery.DeliveryStore:
    store = delivery.DeliveryStore(spark, shared_path(spark, "deliveries"), MESSAGE, "delivery_id", "received_at")
    staged = shared_path(spark, "received")
    for batch in delivery.in_batches(table(spark, d, "pushes"), "delivery_id", batches, staged):
        store.merge(batch)
    delete(spark, staged)
    return store


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _delivered(spark, d).duplicates()


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    """The single copies that the store holds after all batches."""
    return _delivered(spark, d).current().select("delivery_id", *MESSAGE, "push_id", "value")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapdiff.snapshot_changes(table(spark, d, "snapshots"))


def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("snapshot_id", "kind").agg(F.count("*").alias("keys"))


QUERIES = {f.__name__: f for f in (p1_found, p1_items, p1_leases, p1_run_sizes, p2_found, p2_summary, p3_found, p3_state, p3_state_sha64, p3_onto_base, p4_found, p4_kept, p5_found, p5_summary)}

_P1 = """
WITH c AS (SELECT min(seq) AS seq, arg_min(landed_at, seq) AS landed FROM mutations GROUP BY op, key, ts, node_id, value),
ok AS (SELECT started_at, min(run_id) AS run_id FROM sync_runs WHERE status = 'ok' GROUP BY started_at),
f AS (SELECT ok.run_id, c.seq FROM c ASOF JOIN ok ON c.landed <= ok.started_at)
"""
_P2 = """
WITH a AS (SELECT DISTINCT * FROM replica_a), b AS (SELECT DISTINCT * FROM replica_b),
j AS (SELECT coalesce(a.key, b.key) AS key, a.key IS NULL AS no_a, b.key IS NULL AS no_b,
  a.value IS DISTINCT FROM b.value AS dv, a.ts IS DISTINCT FROM b.ts AS dt, a.node_id IS DISTINCT FROM b.node_id AS dn,
  a.tombstone IS DISTINCT FROM b.tombstone AS dd FROM a FULL JOIN b ON a.key = b.key),
f AS (SELECT key, 'only_a' AS diff FROM j WHERE no_b UNION ALL SELECT key, 'only_b' FROM j WHERE no_a
  UNION ALL SELECT key, 'value' FROM j WHERE dv AND NOT no_a AND NOT no_b UNION ALL SELECT key, 'ts' FROM j WHERE dt AND NOT no_a AND NOT no_b
  UNION ALL SELECT key, 'node_id' FROM j WHERE dn AND NOT no_a AND NOT no_b UNION ALL SELECT key, 'tombstone' FROM j WHERE dd AND NOT no_a AND NOT no_b)
"""
_P4 = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY replica, op, key, ts, node_id ORDER BY delivery_id) AS n FROM pushes)
"""
_P5 = """
WITH o AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS o FROM (SELECT DISTINCT snapshot_id FROM snapshots)),
c AS (SELECT o.o, o.snapshot_id, key, value, ts FROM snapshots JOIN o USING (snapshot_id)
  QUALIFY row_number() OVER (PARTITION BY o.o, key ORDER BY ts DESC) = 1 AND NOT tombstone),
j AS (SELECT coalesce(b.o, a.o + 1) AS o, coalesce(b.key, a.key) AS key,
  CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed'
       WHEN a.value IS DISTINCT FROM b.value OR a.ts IS DISTINCT FROM b.ts THEN 'changed' END AS kind
  FROM c b FULL JOIN c a ON b.o = a.o + 1 AND b.key = a.key),
f AS (SELECT o.snapshot_id, j.key, j.kind FROM j JOIN o USING (o) WHERE j.o > 1 AND kind IS NOT NULL)
"""
ORACLE = {
    "p1_found": _P1 + "SELECT run_id, seq FROM f",
    "p1_run_sizes": _P1 + "SELECT run_id, count(*) AS changes, min(seq) AS first_seq, max(seq) AS last_seq FROM f GROUP BY run_id",
    "p1_items": """
WITH a AS (SELECT started_at AS hi, arg_min(struct_pack(r := run_id, t := attempt, ok := coalesce(status, '') = 'ok'),
    (CASE WHEN status = 'ok' THEN 0 ELSE 1 END, run_id, attempt)) AS w FROM sync_runs GROUP BY started_at),
n AS (SELECT hi, lag(hi) OVER (ORDER BY hi) AS lo, row_number() OVER (ORDER BY hi) AS first_token,
    first_value(CASE WHEN w.ok THEN w END IGNORE NULLS) OVER (ORDER BY hi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM a)
SELECT lo, hi, CASE WHEN nx IS NULL THEN 'pending' ELSE 'done' END AS state, nx.r AS run_id, nx.t AS attempt, first_token FROM n""",
    "p1_leases": """
WITH a AS (SELECT started_at AS hi, max(coalesce(status, '') = 'ok') AS ok, row_number() OVER (ORDER BY started_at) AS token, count(*) OVER () AS n FROM sync_runs GROUP BY started_at)
SELECT a.hi, (SELECT min(b.token) FROM a b WHERE b.ok AND b.hi >= a.hi) AS token,
  coalesce((SELECT min(b.token) FROM a b WHERE b.ok AND b.hi >= a.hi), a.n) - a.token + 1 AS leases FROM a""",
    "p2_found": _P2 + "SELECT key, diff FROM f",
    "p2_summary": _P2 + "SELECT diff, count(*) AS keys FROM f GROUP BY diff",
    "p3_state_sha64": f"WITH {LOG_WITH_HASHES} SELECT key, seq, ts, op FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, coalesce(node_id, '') DESC, ih DESC, seq) = 1",
    "p3_onto_base": f"WITH {LOG_WITH_HASHES} SELECT key, ts, op FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, coalesce(node_id, '') DESC, ih DESC, seq) = 1",
    "p4_found": _P4 + "SELECT delivery_id FROM r WHERE n > 1",
    "p4_kept": _P4 + "SELECT delivery_id, replica, op, key, ts, node_id, push_id, value FROM r WHERE n = 1",
    "p5_found": _P5 + "SELECT snapshot_id, key, kind FROM f",
    "p5_summary": _P5 + "SELECT snapshot_id, kind, count(*) AS keys FROM f GROUP BY ALL",
}
