"""Queries of the key-state operators over the test tables, with the SQL that checks them.

Hashes that SQL has to repeat are of the ``sha64`` family; ``xxh64`` is pinned by vectors in the tests. Digests are shown in
hexadecimal, as the two engines have no unsigned type in common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.cluster import Cluster
from keyfold.functions import clock, resp
from keyfold.functions.hashing import long_to_hex, unsigned_mod
from keyfold.functions.hashing import key_hash as hash_of
from keyfold.operators import digest, evict, fold, recovery, replicate
from keyfold.operators.ring import Ring, moved, others, reachable
from keyfold.session import shared_path, table
from keyfold.sources import segments
from keyfold.sources.snapshots import StateStore
from keyfold.store import KVStore
from keyfold.streaming import merge

FAMILY = "sha64"
HOT = "cfg:gateway/limits"
CUT = "2025-03-15 00:00:00"
LRU = evict.Lru(capacity=64, ttl_ms=6 * 3600 * 1000, shards=4)
CASES: dict[str, str | None] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        CASES[f.__name__] = sql
        return f

    return keep


# --- the oracle's arithmetic -------------------------------------------------------------------------------------


def _h(x: str) -> str:
    return f"(('0x' || substr(sha256({x}), 1, 16))::UBIGINT)"


def _rot(x: str, n: int) -> str:
    return f"((({x})::UHUGEINT * {1 << n} % 18446744073709551616)::UBIGINT | (({x}) >> {64 - n}))"


def _item(kh: str, ts: str, node: str, value: str, dead: str) -> str:
    u = f"(CASE WHEN {ts} < 0 THEN ({ts}::HUGEINT + 18446744073709551616)::UBIGINT ELSE {ts}::UBIGINT END)"
    parts = [
        kh, _rot(u, 17), f"(CASE WHEN strlen({node}) > 0 THEN {_rot(_h(node), 31)} ELSE 0::UBIGINT END)",
        f"(CASE WHEN octet_length({value}) > 0 THEN {_rot(_h(value), 47)} ELSE 0::UBIGINT END)", f"(CASE WHEN {dead} THEN 6148914691236517205::UBIGINT ELSE 0::UBIGINT END)",
    ]
    out = parts[0]
    for p in parts[1:]:
        out = f"xor({out}, {p})"
    return out


def _mul(a: str, m: int) -> str:
    """Low 64 bits of a product, from halves that don't overflow."""
    hi, lo = m >> 32, m & 0xFFFFFFFF
    w = "18446744073709551616"
    return f"(((({a})::UHUGEINT * {lo}) % {w} + ((({a})::UHUGEINT * {hi}) % {w} * 4294967296) % {w}) % {w})::UBIGINT"


def _mix_steps(table_: str, n: str) -> str:
    """Nested selects that end in a column ``mc``, the mixed count ``n``."""
    a = f"SELECT *, ({n} + 1)::UBIGINT AS m0 FROM {table_}"
    b = f"SELECT *, {_mul('xor(m0, m0 >> 30)', 0xBF58476D1CE4E5B9)} AS m1 FROM ({a})"
    c = f"SELECT *, {_mul('xor(m1, m1 >> 27)', 0x94D049BB133111EB)} AS m2 FROM ({b})"
    return f"SELECT *, xor(m2, m2 >> 31) AS mc FROM ({c})"


_HEX = "lower(lpad(hex({}), 16, '0'))"
_M = f"""m AS (SELECT seq, op, key, CASE WHEN op = 'set' THEN value END AS value, ts, node_id, op = 'del' AS tombstone, landed_at, {_h('key')} AS kh FROM mutations),
r AS (SELECT *, {_item('kh', 'ts', 'node_id', 'value', 'tombstone')} AS ih FROM m)"""
LOG_WITH_HASHES = _M
_BEST = "ORDER BY ts DESC, coalesce(node_id, '') DESC, ih DESC, value DESC NULLS LAST, node_id DESC NULLS LAST"
_E = _M + f""",
e AS (SELECT *, (kh & 127)::INT AS shard, ((kh >> 16) & 63)::INT AS sub FROM r QUALIFY row_number() OVER (PARTITION BY key {_BEST}) = 1)"""
_ENTRY = "key, value, ts, node_id, tombstone"


def _copy(t: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, {_h('key')} AS kh FROM {t}), {name}1 AS (SELECT *, {_item('kh', 'ts', 'node_id', 'value', 'tombstone')} AS ih FROM {name}0),
{name} AS (SELECT *, (kh & 127)::INT AS shard, ((kh >> 16) & 63)::INT AS sub FROM {name}1 QUALIFY row_number() OVER (PARTITION BY key {_BEST}) = 1)"""


def _subs(e: str, name: str) -> str:
    spine = "SELECT (i // 64)::INT AS shard, (i % 64)::INT AS sub FROM range(8192) t(i)"
    sums = f"SELECT shard, sub, bit_xor(ih) AS x, count(*) AS cnt FROM {e} GROUP BY ALL"
    joined = f"(SELECT shard, sub, coalesce(x, 0::UBIGINT) AS x, coalesce(cnt, 0) AS cnt FROM ({spine}) LEFT JOIN ({sums}) USING (shard, sub))"
    return f"{name} AS (SELECT shard, sub, cnt, xor(x, mc) AS digest FROM ({_mix_steps(joined, 'cnt')}))"


def _shards(e: str, name: str) -> str:
    joined = f"(SELECT shard, coalesce(x, 0::UBIGINT) AS x, coalesce(cnt, 0) AS cnt FROM (SELECT i::INT AS shard FROM range(128) t(i)) LEFT JOIN (SELECT shard, bit_xor(ih) AS x, count(*) AS cnt FROM {e} GROUP BY ALL) USING (shard))"
    return f"{name} AS (SELECT shard, cnt, xor(x, mc) AS digest FROM ({_mix_steps(joined, 'cnt')}))"


_VN = """vn AS (SELECT node_id, j, substr(sha256(node_id || '-' || j::VARCHAR), 1, 16) AS vhash FROM ({}) n, range(128) t(j) WHERE j < n.w)"""
_NODES = "SELECT node_id, CASE WHEN weight < 0 THEN 128 ELSE weight END AS w FROM nodes"


def _owner(keys: str, vn: str, name: str) -> str:
    return f"""{name} AS (SELECT k.key, coalesce(v.node_id, (SELECT arg_min(node_id, vhash) FROM {vn})) AS owner
 FROM (SELECT key, substr(sha256(key), 1, 16) AS h FROM {keys}) k ASOF LEFT JOIN {vn} v ON k.h <= v.vhash)"""


def _owners(keys: str, rf: int, name: str) -> str:
    """Owners in clockwise order with their place."""
    return f"""p AS (SELECT node_id, vhash, row_number() OVER (ORDER BY vhash) AS i, count(*) OVER () AS n FROM vn),
pp AS (SELECT node_id, i FROM p UNION ALL SELECT node_id, i + n FROM p),
d AS (SELECT p.i, pp.node_id, min(pp.i) AS mn FROM p JOIN pp ON pp.i >= p.i AND pp.i < p.i + p.n GROUP BY ALL),
o AS (SELECT i, node_id, row_number() OVER (PARTITION BY i ORDER BY mn) - 1 AS pos FROM d QUALIFY pos < {rf}),
k AS (SELECT key, substr(sha256(key), 1, 16) AS h FROM {keys}),
ki AS (SELECT k.key, coalesce(p.i, 1) AS i FROM k ASOF LEFT JOIN p ON k.h <= p.vhash),
{name} AS (SELECT ki.key, o.pos, o.node_id AS replica FROM ki JOIN o USING (i))"""


_CUST = "c AS (SELECT c_custkey, c_name AS key FROM customer)"
_ACC = """a AS (SELECT event_id AS seq, 'user:' || user_id AS key, epoch_us(ts) // 1000 AS "at", CASE WHEN event_type = 'error' THEN 'delete' ELSE 'seen' END AS kind FROM events)"""


# --- inputs ------------------------------------------------------------------------------------------------------


def log_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mutations")


def entries_of(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold(fold.as_entries(log_of(spark, d)), FAMILY)


def copy_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A replica's state; rows that are repeated fold into one."""
    return fold.hashed(fold.fold(table(spark, d, name).select(*fold.ENTRY), FAMILY), FAMILY)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("key"))


def ring_of(spark: SparkSession, d: str) -> Ring:
    return Ring.of(table(spark, d, "nodes"))


def millis(c: str = "ts"):
    return F.unix_millis(F.col(c).cast("timestamp"))


def accesses_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("seen")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), millis().alias("at"), kind.alias("kind"))


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", long_to_hex(F.col("digest")))


# --- reading and folding -----------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT {_ENTRY} FROM e WHERE key = '{HOT}' AND NOT tombstone")
def kv_point_get(spark, d):
    return fold.get(log_of(spark, d), HOT, FAMILY)


@query(f"WITH {_E} SELECT k.key, e.value, e.key IS NOT NULL AS found FROM (SELECT DISTINCT key FROM replica_a) k LEFT JOIN e ON e.key = k.key AND NOT e.tombstone")
def kv_multi_get(spark, d):
    return fold.multi_get(entries_of(spark, d), table(spark, d, "replica_a").select("key").distinct())


@query(f"WITH {_E} SELECT k.key, count(e.key)::INT AS existing FROM (SELECT DISTINCT key FROM replica_a) k LEFT JOIN e ON e.key = k.key AND NOT e.tombstone GROUP BY k.key")
def kv_exists(spark, d):
    return kv_multi_get(spark, d).select("key", F.col("found").cast("int").alias("existing"))


@query(f"WITH {_E} SELECT {_ENTRY} FROM e")
def lww_latest(spark, d):
    return entries_of(spark, d)


@query(f"WITH {_E} SELECT {_ENTRY} FROM e WHERE NOT tombstone")
def lww_live(spark, d):
    return fold.live(entries_of(spark, d))


@query(f"WITH {_E} SELECT key, ts, node_id FROM e WHERE tombstone")
def lww_tombstones(spark, d):
    return entries_of(spark, d).where("tombstone").select("key", "ts", "node_id")


_JUDGED = f"""{_M}, k AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY ts, coalesce(node_id, ''), ih) AS rk FROM r),
j AS (SELECT *, rk > coalesce(max(rk) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM k)"""


@query(f"WITH {_JUDGED} SELECT seq, key FROM j WHERE NOT accepted")
def lww_stale_rejected(spark, d):
    return fold.judged(log_of(spark, d), FAMILY).where("not accepted").select("seq", "key")


@query(f"WITH {_JUDGED} SELECT seq, {_ENTRY} FROM j WHERE accepted")
def lww_accepted_log(spark, d):
    """What goes into the log: only accepted writes do."""
    return fold.judged(log_of(spark, d), FAMILY).where("accepted").drop("accepted")


@query(f"WITH {_M} SELECT {_ENTRY} FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def map_overwrite(spark, d):
    """Writes without any comparison: the last to arrive stays."""
    return fold.overwrite(log_of(spark, d))


@query(f"WITH {_E} SELECT {_ENTRY} FROM e ANTI JOIN replica_a USING (key)")
def map_removed(spark, d):
    """Entries without those of given keys."""
    return fold.remove(entries_of(spark, d), table(spark, d, "replica_a"))


_DEL = "l AS (SELECT seq, key, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS prev FROM mutations)"


@query(f"WITH {_DEL} SELECT seq, key, coalesce(prev = 'set', false) AS existed, coalesce(prev = 'set', false) AS writes FROM l WHERE op = 'del'")
def delete_existed_single(spark, d):
    return fold.deletes_existed(log_of(spark, d))


@query(f"WITH {_DEL} SELECT seq, key, coalesce(prev = 'set', false) AS existed, true AS writes FROM l WHERE op = 'del'")
def delete_existed_cluster(spark, d):
    return fold.deletes_existed(log_of(spark, d), cluster=True)


@query(f"WITH {_M} SELECT key, value, ts, NULL::VARCHAR AS node_id, tombstone FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) = 1")
def wal_replay_ts_only(spark, d):
    return fold.replay_by_clock(log_of(spark, d))


_EVENT_LOG = """(SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS op, 'user:' || user_id AS key, encode(props) AS value,
 ((epoch_us(ts) // 1000) * 65536)::BIGINT AS ts, 'node-' || (event_id % 3 + 1) AS node_id, ts AS landed_at FROM events)"""


@query(f"WITH {_M.replace('FROM mutations', 'FROM ' + _EVENT_LOG)} SELECT key, value, ts, node_id FROM r QUALIFY row_number() OVER (PARTITION BY key {_BEST}) = 1 AND NOT tombstone")
def events_live(spark, d):
    """The events as a log of mutations: their live state."""
    e = table(spark, d, "events")
    log = e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "del").otherwise("set").alias("op"), F.concat(F.lit("user:"), "user_id").alias("key"),
        F.encode("props", "utf-8").alias("value"), clock.pack(millis(), F.lit(0)).alias("ts"), F.concat(F.lit("node-"), (F.col("event_id") % 3 + 1)).alias("node_id"),
    )
    return fold.live(fold.fold(fold.as_entries(log), FAMILY)).drop("tombstone")


@query(f"WITH {_E} SELECT shard, sub, {_ENTRY} FROM e WHERE shard = 7 AND sub < 32")
def map_range_buckets(spark, d):
    return fold.scan_buckets(fold.hashed(entries_of(spark, d), FAMILY), 7, list(range(32))).select("shard", "sub", *fold.ENTRY)


@query(f"WITH {_E} SELECT key, {_HEX.format('kh')} AS key_hash, {_HEX.format('ih')} AS item_hash, shard, sub FROM e")
def map_hashes(spark, d):
    h = fold.hashed(entries_of(spark, d), FAMILY)
    return h.select("key", long_to_hex(F.col("key_hash")).alias("key_hash"), long_to_hex(F.col("item_hash")).alias("item_hash"), "shard", "sub")


# --- log and snapshots -------------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT {_ENTRY} FROM e")
def snapshot_plus_tail(spark, d):
    log = log_of(spark, d)
    old = fold.fold(fold.as_entries(log.where(F.col("landed_at") < CUT)), FAMILY)
    return recovery.recover(old, log.where(F.col("landed_at") >= CUT), FAMILY)


@query(f"WITH {_E} SELECT {_ENTRY} FROM e")
def snapshot_store(spark, d):
    """The same through a store on disk: append, snapshot, append, drop the covered log, recover."""
    store = StateStore(spark, shared_path(spark, "store"), FAMILY)
    log = log_of(spark, d)
    store.append(log.where(F.col("landed_at") < CUT))
    store.snapshot()
    store.append(log.where(F.col("landed_at") >= CUT))
    store.clear_log()
    return store.state()


@query(f"""WITH {_M}, s AS (SELECT seq, op, key, ts, (kh % 16)::INT AS segment, landed_at FROM r),
o AS (SELECT segment, max(seq) AS o FROM s WHERE seq <= (SELECT max(seq) FROM mutations WHERE landed_at < '{CUT}+00') GROUP BY segment)
SELECT seq, op, key, ts, s.segment FROM s LEFT JOIN o ON s.segment = o.segment WHERE o.o IS NULL OR s.seq > o.o""")
def compaction_tail(spark, d):
    log = recovery.segmented(log_of(spark, d), 16, FAMILY)
    upto = log.where(F.col("landed_at") < CUT).agg(F.max("seq")).first()[0]
    return recovery.clear(log, recovery.offsets(log, upto if upto is not None else -1)).select("seq", "op", "key", "ts", "segment")


@query(f"WITH {_M} SELECT n::INT AS segments, (kh % n)::INT AS segment, count(*) AS entries FROM r, (VALUES (3), (16)) v(n) GROUP BY ALL")
def wal_segments(spark, d):
    h = hash_of(F.col("key"), FAMILY)
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("segments"), unsigned_mod(h, n).alias("segment")) for n in (3, 16))))
    return log_of(spark, d).select(parts.alias("p")).groupBy("p.segments", "p.segment").agg(F.count("*").alias("entries"))


@query("SELECT op, key, CASE WHEN op = 'set' THEN coalesce(value, ''::BLOB) END AS value, ts, coalesce(node_id, '') AS node_id FROM mutations")
def wal_binary_round_trip(spark, d):
    path = shared_path(spark, "log").removeprefix("file://")
    segments.append(log_of(spark, d), path)
    return segments.read(spark, path).select("op", "key", "value", "ts", "node_id")


@query(f"WITH {_E} SELECT {_ENTRY} FROM e")
def stream_persisted(spark, d):
    """The log as a stream, appended to a store batch by batch, with snapshots in between."""
    store = StateStore(spark, shared_path(spark, "streamed"), FAMILY)
    log, arrived = log_of(spark, d), shared_path(spark, "arrived")
    log.repartitionByRange(20, "seq").write.mode("overwrite").parquet(arrived)  # five batches, of which the last is the tail
    feed = merge.log_feed(spark, arrived, log.schema, 4)
    merge.persist(feed, store, shared_path(spark, "progress"), snapshot_every=2).awaitTermination()
    return store.state()


# --- placement ---------------------------------------------------------------------------------------------------


@query(f"WITH {_VN.format(_NODES)} SELECT node_id, j::INT AS vnode, vhash FROM vn")
def ring_vnodes(spark, d):
    return ring_of(spark, d).vnode_table(spark)


@query(f"WITH {_CUST}, {_VN.format(_NODES)}, {_owner('c', 'vn', 'f')} SELECT key, owner FROM f")
def ring_owner(spark, d):
    return ring_of(spark, d).owner(customers(spark, d).select("key"))


@query(f"WITH {_CUST}, {_VN.format(_NODES)}, {_owners('c', 3, 'f')} SELECT key, list(replica ORDER BY pos) AS owners FROM f GROUP BY key")
def ring_owners_rf3(spark, d):
    return ring_of(spark, d).place(customers(spark, d).select("key"), 3)


@query(f"WITH c AS (SELECT 'order:' || o_orderkey AS key FROM orders), {_VN.format(_NODES)}, {_owner('c', 'vn', 'f')} SELECT owner, count(*) AS keys FROM f GROUP BY owner")
def ring_distribution(spark, d):
    keys = table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("key"))
    return ring_of(spark, d).owner(keys).groupBy("owner").agg(F.count("*").alias("keys"))


def _moved(nodes: str) -> str:
    two = _VN.format(nodes).replace("vn AS", "vm AS")
    return f"WITH {_CUST}, {_VN.format(_NODES)}, {two}, {_owner('c', 'vn', 'f')}, {_owner('c', 'vm', 'g')} SELECT key, f.owner AS old_owner, g.owner AS new_owner FROM f JOIN g USING (key) WHERE f.owner <> g.owner"


@query(_moved(f"SELECT node_id, CASE WHEN node_id = 'node-02' THEN 16 ELSE w END AS w FROM ({_NODES})"))
def ring_reweight(spark, d):
    r = ring_of(spark, d)
    return moved(customers(spark, d), r, r.reweighted("node-02", 16))


@query(_moved(f"SELECT * FROM ({_NODES}) WHERE node_id <> 'node-03'"))
def ring_remove_moved_keys(spark, d):
    r = ring_of(spark, d)
    return moved(customers(spark, d), r, r.removed("node-03"))


@query(_moved(f"SELECT * FROM ({_NODES}) UNION ALL SELECT 'node-77', 128"))
def ring_add_moved_keys(spark, d):
    r = ring_of(spark, d)
    return moved(customers(spark, d), r, r.added({"node-77": 128}))


# --- replication -------------------------------------------------------------------------------------------------


@query(f"WITH {_CUST}, {_VN.format(_NODES)}, {_owners('c', 3, 'f')} SELECT key, pos::INT AS pos, replica FROM f")
def replica_fanout(spark, d):
    return replicate.fan_out(customers(spark, d).select("key"), ring_of(spark, d), 3)


def _attempts(spark, d):
    f = replicate.fan_out(customers(spark, d), ring_of(spark, d), 2)
    return f.select(F.col("c_custkey").alias("write_id"), "replica", ((F.col("c_custkey") * 7 + F.col("pos") * 3) % 5 < 2).alias("failed"))


_OUT = f"WITH {_CUST}, {_VN.format(_NODES)}, {_owners('c', 2, 'f')}, t AS (SELECT c_custkey AS write_id, count(*) AS owners, count(*) FILTER ((c_custkey * 7 + pos * 3) % 5 < 2) AS failed FROM f JOIN c USING (key) GROUP BY ALL)"


@query(_OUT + " SELECT write_id, owners, failed, failed = 0 AS ok FROM t")
def replication_strict(spark, d):
    return replicate.outcome(_attempts(spark, d), "strict")


@query(_OUT + " SELECT write_id, owners, failed, failed < owners AS ok FROM t")
def replication_lenient(spark, d):
    return replicate.outcome(_attempts(spark, d), "lenient")


def _states(spark, d):
    """What each owner holds of each key: some miss it, some hold a tombstone."""
    f = replicate.fan_out(customers(spark, d), ring_of(spark, d), 3)
    n = F.col("c_custkey") + F.substring("replica", 6, 2).cast("int")
    return f.where(n % 3 != 0).select("replica", "key", F.encode(F.concat("key", F.lit("@"), "replica"), "utf-8").alias("value"), (n % 5 == 0).alias("tombstone"))


_ST = f"""WITH {_CUST}, {_VN.format(_NODES)}, {_owners('c', 3, 'f')},
n AS (SELECT key, pos, replica, c_custkey + substr(replica, 6, 2)::INT AS n FROM f JOIN c USING (key)),
st AS (SELECT key, pos, replica, encode(key || '@' || replica) AS value, n % 5 = 0 AS tombstone FROM n WHERE n % 3 <> 0)"""


@query(_ST + " SELECT c.key, b.value, b.replica FROM c LEFT JOIN (SELECT key, arg_min(value, pos) AS value, arg_min(replica, pos) AS replica FROM st WHERE NOT tombstone GROUP BY key) b USING (key)")
def read_first_owner(spark, d):
    return replicate.first_owner_read(customers(spark, d), _states(spark, d), ring_of(spark, d), 3)


@query(_ST + """, q AS (SELECT *, CASE WHEN replica = 'node-05' THEN -1 ELSE pos END AS p FROM st WHERE replica = 'node-05' OR NOT tombstone),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY key ORDER BY p) = 1)
SELECT c.key, CASE WHEN NOT b.tombstone THEN b.value END AS value, CASE WHEN NOT b.tombstone THEN b.replica END AS replica FROM c LEFT JOIN b USING (key)""")
def read_from_owner_node(spark, d):
    """Reads that node-05 is asked for: its own copy first, and its tombstone is final."""
    return replicate.first_owner_read(customers(spark, d), _states(spark, d), ring_of(spark, d), 3, requester="node-05")


@query(_ST + " SELECT c.key, coalesce(bool_or(NOT st.tombstone), false) AS existed FROM c LEFT JOIN st USING (key) GROUP BY c.key")
def delete_exists_anywhere(spark, d):
    return replicate.exists_anywhere(customers(spark, d), _states(spark, d), ring_of(spark, d), 3)


@query(f"""WITH {_M}, {_VN.format(_NODES)}, {_owners('(SELECT DISTINCT key FROM mutations)', 3, 'f')},
w AS (SELECT f.replica, r.* FROM r JOIN f USING (key) WHERE (seq + substr(f.replica, 6, 2)::INT) % 10 <> 0)
SELECT replica, {_ENTRY} FROM w QUALIFY row_number() OVER (PARTITION BY replica, key {_BEST}) = 1""")
def replica_states(spark, d):
    """State of every replica after the log was sent to the owners of its keys and a tenth of the messages got lost."""
    sent = replicate.fan_out(log_of(spark, d), ring_of(spark, d), 3)
    got = sent.where((F.col("seq") + F.substring("replica", 6, 2).cast("int")) % 10 != 0)
    writes = fold.as_entries(got, keep=("seq", "replica"))
    return fold.fold(writes, FAMILY, by=("replica",))


@query(f"""WITH {_M}, {_VN.format(_NODES)}, {_owners('(SELECT DISTINCT key FROM mutations)', 3, 'f')},
w AS (SELECT f.replica, r.* FROM r JOIN f USING (key) WHERE (seq + substr(f.replica, 6, 2)::INT) % 10 <> 0),
pr AS (SELECT node_id AS me, coalesce(lead(node_id) OVER (ORDER BY node_id), min(node_id) OVER ()) AS peer FROM nodes),
sent AS (SELECT pr.me AS replica, w.* EXCLUDE (replica) FROM w JOIN pr ON w.replica = pr.peer JOIN f ON f.key = w.key AND f.replica = pr.me),
al AS (SELECT * FROM w UNION ALL BY NAME SELECT * FROM sent)
SELECT replica, {_ENTRY} FROM al QUALIFY row_number() OVER (PARTITION BY replica, key {_BEST}) = 1""")
def cluster_round(spark, d):
    """The same through the stores of a cluster, after one round in which each node pulled from the next one by name."""
    c = Cluster(spark, shared_path(spark, "cluster"), ring_of(spark, d), family=FAMILY)
    c.write(log_of(spark, d), (F.col("seq") + F.substring("replica", 6, 2).cast("int")) % 10 == 0)
    c.round()
    return c.states()


@query("SELECT node_id, grpc_port, weight FROM nodes WHERE grpc_port > 0 AND node_id <> 'node-04'")
def members_besides_self(spark, d):
    return others(reachable(table(spark, d, "nodes")), "node-04").select("node_id", "grpc_port", "weight")


# --- digests and exchange ----------------------------------------------------------------------------------------


@query(f"WITH {_E}, {_subs('e', 's')} SELECT shard, sub, cnt, {_HEX.format('digest')} AS digest FROM s")
def digest_sub(spark, d):
    return shown(digest.sub_digests(fold.hashed(entries_of(spark, d), FAMILY)))


@query(f"WITH {_E}, {_shards('e', 's')} SELECT shard, cnt, {_HEX.format('digest')} AS digest FROM s")
def digest_shard(spark, d):
    return shown(digest.shard_digests(fold.hashed(entries_of(spark, d), FAMILY)))


@query(f"WITH {_E}, {_shards('e', 's')} SELECT sum(cnt)::BIGINT AS cnt, {_HEX.format('bit_xor(digest)')} AS digest FROM s")
def digest_root(spark, d):
    return shown(digest.root_digest(fold.hashed(entries_of(spark, d), FAMILY)))


_AB = f"WITH {_copy('replica_a', 'a')}, {_copy('replica_b', 'b')}, {_subs('a', 'sa')}, {_subs('b', 'sb')}, bad AS (SELECT shard, sub FROM sa JOIN sb USING (shard, sub) WHERE sa.digest <> sb.digest)"


@query(_AB + " SELECT shard, sub FROM bad")
def digest_diff_buckets(spark, d):
    return digest.mismatched(copy_of(spark, d, "replica_a"), copy_of(spark, d, "replica_b"))


@query(_AB + f" SELECT {_ENTRY} FROM b SEMI JOIN bad USING (shard, sub)")
def entropy_pull(spark, d):
    return digest.pull(copy_of(spark, d, "replica_a"), copy_of(spark, d, "replica_b"))


@query(_AB + f", {_VN.format(_NODES)}, {_owners('(SELECT key FROM b SEMI JOIN bad USING (shard, sub))', 3, 'f')} SELECT {_ENTRY} FROM b SEMI JOIN (SELECT key FROM f WHERE replica = 'node-03') USING (key) SEMI JOIN bad USING (shard, sub)")
def entropy_responsible_only(spark, d):
    return digest.pull(copy_of(spark, d, "replica_a"), copy_of(spark, d, "replica_b"), "node-03", ring_of(spark, d), 3)


_PARTIAL = """, bad2 AS (SELECT shard, sub FROM sb WHERE (shard % 5 = 0 AND shard IN (SELECT shard FROM xa JOIN xb USING (shard) WHERE xa.digest <> xb.digest)) UNION SELECT shard, sub FROM bad)"""


@query(_AB + f", {_shards('a', 'xa')}, {_shards('b', 'xb')}" + _PARTIAL + f" SELECT {_ENTRY} FROM b SEMI JOIN bad2 USING (shard, sub)")
def entropy_answer(spark, d):
    """The answer to a request that lacks some bucket digests in every fifth shard, which is then sent whole if it differs."""
    asked = digest.request(copy_of(spark, d, "replica_a")).where("level != 'sub' or shard % 5 != 0 or sub < 60")
    return digest.answer(asked, copy_of(spark, d, "replica_b"))


@query(f"WITH {_copy('(SELECT * FROM replica_a UNION ALL SELECT * FROM replica_b)', 'e')}, {_shards('e', 's')}, g AS (SELECT {_HEX.format('bit_xor(digest)')} AS digest, sum(cnt)::BIGINT AS cnt FROM s) SELECT r AS replica, cnt, digest FROM g, (VALUES ('a'), ('b')) v(r)")
def entropy_push_converged(spark, d):
    """Roots of both replicas after each pulled from the other."""
    a, b = copy_of(spark, d, "replica_a"), copy_of(spark, d, "replica_b")
    a2 = fold.hashed(digest.merge(a, digest.pull(a, b), family=FAMILY), FAMILY)
    b2 = fold.hashed(digest.merge(b, digest.pull(b, a), family=FAMILY), FAMILY)
    roots = [shown(digest.root_digest(x)).withColumn("replica", F.lit(n)) for n, x in (("a", a2), ("b", b2))]
    return roots[0].unionByName(roots[1])


# --- eviction ----------------------------------------------------------------------------------------------------

_RES = f"""WITH {_ACC}, l AS (SELECT key, max(seq) AS seq, arg_max("at", seq) AS "at" FROM a WHERE kind = 'seen' GROUP BY key),
s AS (SELECT *, ({_h('key')} % {LRU.shards})::INT AS shard FROM l), res AS (SELECT key, shard, "at" FROM s QUALIFY row_number() OVER (PARTITION BY shard ORDER BY seq DESC) <= {LRU.per_shard})"""


@query(_RES + ' SELECT key, shard, "at" FROM res')
def lru_resident(spark, d):
    """The keys seen last, as its SQL has them: deletes and ages are passed over. ``lru_held`` is what the cache holds."""
    return evict.recent(accesses_of(spark, d), LRU, FAMILY)


@query(_RES + " SELECT key FROM l ANTI JOIN res USING (key)")
def lru_evicted(spark, d):
    """All other keys ever seen, as its SQL has them; ``lru_lost`` is what was evicted."""
    return evict.not_recent(accesses_of(spark, d), LRU, FAMILY)


@query()
def lru_held(spark, d):
    """What the cache holds after all accesses, deletes and ages."""
    return evict.resident(accesses_of(spark, d), LRU, FAMILY)


@query()
def lru_lost(spark, d):
    return evict.evicted(accesses_of(spark, d), LRU, FAMILY)


@query(f"""WITH {_M}, s AS (SELECT * FROM r WHERE op = 'set'), l AS (SELECT key, max(seq) AS seq, any_value(kh) AS kh FROM s GROUP BY key),
res AS (SELECT key FROM l QUALIFY row_number() OVER (PARTITION BY kh % {LRU.shards} ORDER BY seq DESC) <= {LRU.per_shard})
SELECT {_ENTRY} FROM s SEMI JOIN res USING (key) QUALIFY row_number() OVER (PARTITION BY key {_BEST}) = 1""")
def store_evicts(spark, d):
    """What a store with room for a few keys holds after all sets of the log: the replayed cache decides, a snapshot drops the rest."""
    sets = log_of(spark, d).where("op = 'set'")
    kv = KVStore(spark, shared_path(spark, "small"), family=FAMILY, lru=evict.Lru(LRU.capacity, 0, LRU.shards))
    kv.store.append(sets)
    kv.take_accesses(sets.select("seq", "key", F.lit(0).cast("long").alias("at"), F.lit("seen").alias("kind")))
    kv.evict()
    return kv.store.state()


@query()
def lru_events(spark, d):
    return evict.events(accesses_of(spark, d), LRU, FAMILY)


@query(f"""WITH {_ACC}, l AS (SELECT key, arg_max("at", seq) AS "at", arg_max(kind, seq) AS kind FROM a GROUP BY key), n AS (SELECT max("at") AS now FROM a) SELECT key, "at" FROM l, n WHERE kind = 'seen' AND "at" + {LRU.ttl_ms} <= now""")
def ttl_expired(spark, d):
    a = accesses_of(spark, d)
    return evict.expired(a, a.agg(F.max("at")).first()[0], LRU)


@query(f"""WITH {_ACC}, g AS (SELECT key, "at", CASE WHEN "at" - lag("at") OVER w >= {LRU.ttl_ms} OR lag("at") OVER w IS NULL THEN 1 ELSE 0 END AS new FROM a WHERE kind = 'seen' WINDOW w AS (PARTITION BY key ORDER BY "at")),
s AS (SELECT key, "at", sum(new) OVER (PARTITION BY key ORDER BY "at") AS n FROM g)
SELECT key, make_timestamp(min("at") * 1000) AS born, make_timestamp((max("at") + {LRU.ttl_ms}) * 1000) AS dies, count(*) AS accesses FROM s GROUP BY key, n""")
def ttl_sliding_sessions(spark, d):
    return evict.lifetimes(accesses_of(spark, d), LRU.ttl_ms).select("key", F.col("born").cast("timestamp_ntz").alias("born"), F.col("dies").cast("timestamp_ntz").alias("dies"), "accesses")


@query(_RES + f" SELECT count(*) AS cached, {LRU.per_shard * LRU.shards}::BIGINT AS capacity, count(*) / {LRU.per_shard * LRU.shards} AS occupancy, CASE WHEN count(*) / {LRU.per_shard * LRU.shards} >= 0.9 THEN 16 WHEN count(*) / {LRU.per_shard * LRU.shards} >= 0.8 THEN 64 ELSE 128 END AS weight FROM res")
def occupancy_weight(spark, d):
    """How full the cache is with the keys of ``lru_resident``, as its SQL has it; ``occupancy_held`` is how full it is."""
    o = evict.occupancy(evict.recent(accesses_of(spark, d), LRU, FAMILY), LRU)
    return o.withColumn("weight", evict.ring_weight(F.col("occupancy")))


@query()
def occupancy_held(spark, d):
    o = evict.occupancy(lru_held(spark, d), LRU)
    return o.withColumn("weight", evict.ring_weight(F.col("occupancy")))


@query("""WITH s AS (SELECT user_id % 7 AS node_id, event_id AS seq, (event_id * 37 % 101) / 100 AS o FROM events),
w AS (SELECT *, CASE WHEN o >= 0.9 THEN 16 WHEN o >= 0.8 THEN 64 ELSE 128 END AS weight FROM s)
SELECT node_id, seq, weight FROM w QUALIFY weight <> lag(weight, 1, 128) OVER (PARTITION BY node_id ORDER BY seq)""")
def occupancy_weight_changes(spark, d):
    e = table(spark, d, "events")
    s = e.select((F.col("user_id") % 7).alias("node_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 101 / 100).alias("occupancy"))
    return evict.weight_changes(s)


# --- clock -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, ((epoch_us(ts) // 1000) * 65536 + event_id % 100)::BIGINT AS hlc, epoch_us(ts) // 1000 AS ms, (event_id % 100)::INT AS logical FROM events")
def hlc_pack_unpack(spark, d):
    h = table(spark, d, "events").select("event_id", clock.pack(millis(), F.col("event_id") % 100).alias("hlc"))
    return h.select("event_id", "hlc", clock.ms_of(F.col("hlc")).alias("ms"), clock.logical_of(F.col("hlc")).alias("logical"))


@query("""WITH s AS (SELECT 'node-' || (user_id % 4) AS node_id, event_id AS seq, epoch_us(ts) // 1000 AS ms FROM events),
p AS (SELECT *, max(ms) OVER (PARTITION BY node_id ORDER BY seq) AS p FROM s)
SELECT node_id, seq, ms, (p * 65536 + row_number() OVER (PARTITION BY node_id, p ORDER BY seq) - 1)::BIGINT AS ts FROM p""")
def hlc_now_sequence(spark, d):
    s = table(spark, d, "events").select(F.concat(F.lit("node-"), F.col("user_id") % 4).alias("node_id"), F.col("event_id").alias("seq"), millis().alias("ms"))
    return clock.now_sequence(s)


@query("SELECT seq, ts >= 0 AND (ts >> 16) <= epoch_us(landed_at) // 1000 + 5000 AS believed FROM mutations")
def hlc_drift_filter(spark, d):
    m = log_of(spark, d)
    return m.select("seq", clock.believed(F.col("ts"), millis("landed_at")).alias("believed"))


@query("""WITH e AS (SELECT node_id, seq, greatest(epoch_us(landed_at) // 1000, 0) AS ms, CASE WHEN seq % 3 > 0 THEN ts END AS remote FROM mutations WHERE node_id IS NOT NULL),
b AS (SELECT *, remote IS NULL OR (remote >= 0 AND (remote >> 16) <= ms + 5000) AS step, greatest(ms * 65536, coalesce(remote + 1, 0)) AS c FROM e),
k AS (SELECT *, sum(step::INT) OVER (PARTITION BY node_id ORDER BY seq) AS k FROM b)
SELECT node_id, seq, (k + greatest(0, coalesce(max(CASE WHEN step THEN c - k END) OVER (PARTITION BY node_id ORDER BY seq), 0)))::BIGINT AS ts FROM k""")
def hlc_states(spark, d):
    """State of each node's clock as it takes in the mutations that name it."""
    m = log_of(spark, d).where("node_id is not null")
    own = F.when(F.col("seq") % 3 > 0, F.col("ts"))
    return clock.run_clock(m.select("node_id", "seq", millis("landed_at").alias("ms"), own.alias("remote")))


# --- wire protocol -----------------------------------------------------------------------------------------------


def _requests(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("seq"), resp.encode(F.lit("SET"), F.col("c_name"), F.col("c_mktsegment")).alias("bytes"))


def _bulk_sql(x: str) -> str:
    return f"encode('$' || octet_length(encode({x})) || chr(13) || chr(10) || {x} || chr(13) || chr(10))"


@query(f"SELECT c_custkey AS seq, encode('*3' || chr(13) || chr(10)) || {_bulk_sql(repr('SET'))} || {_bulk_sql('c_name')} || {_bulk_sql('c_mktsegment')} AS bytes FROM customer")
def resp_encode(spark, d):
    return _requests(spark, d)


@query("SELECT c_custkey AS seq, 'SET' AS cmd, c_name AS key, c_mktsegment AS value FROM customer")
def resp_decode(spark, d):
    frames = resp.decode(_requests(spark, d).withColumn("conn", F.lit(1)))
    s = lambda i: F.decode(F.col("args")[i], "utf-8")
    return frames.where("ok").select("seq", s(0).alias("cmd"), s(1).alias("key"), s(2).alias("value"))


_CMD = """c AS (SELECT event_id AS seq, event_type AS t, 'user:' || user_id AS key, props FROM events),
w AS (SELECT *, last_value(CASE WHEN t = 'click' THEN 'set' WHEN t = 'error' THEN 'del' END IGNORE NULLS) OVER b AS prev,
  last_value(CASE WHEN t = 'click' THEN props WHEN t = 'error' THEN '' END IGNORE NULLS) OVER b AS held FROM c WINDOW b AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_NL = "chr(13) || chr(10)"


@query(f"""WITH {_CMD} SELECT seq, CASE t WHEN 'click' THEN encode('+OK' || {_NL}) WHEN 'view' THEN CASE WHEN prev = 'set' THEN {_bulk_sql('held')} ELSE encode('$-1' || {_NL}) END
  WHEN 'error' THEN encode((CASE WHEN prev = 'set' THEN ':1' ELSE ':0' END) || {_NL}) WHEN 'signup' THEN encode((CASE WHEN prev = 'set' THEN ':1' ELSE ':0' END) || {_NL})
  ELSE encode('+PONG' || {_NL}) END AS reply FROM w""")
def resp_dispatch(spark, d):
    """Events as commands: clicks set, views get, errors delete, signups ask, purchases ping."""
    e = table(spark, d, "events")
    b = lambda *cs: F.array(*(c.cast("binary") for c in cs))
    key, t = F.concat(F.lit("user:"), "user_id"), F.col("event_type")
    args = (
        F.when(t == "click", b(F.lit("set"), key, F.col("props"))).when(t == "view", b(F.lit("GET"), key)).when(t == "error", b(F.lit("Del"), key))
        .when(t == "signup", b(F.lit("EXISTS"), key)).otherwise(b(F.lit("PING")))
    )
    return resp.dispatch(e.select(F.col("event_id").alias("seq"), args.alias("args")))


ORACLE = {k: v for k, v in CASES.items() if v}
