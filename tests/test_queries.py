"""Every query of the core against the SQL that checks it, and the plans of some."""

from __future__ import annotations

import os

import duckdb
import pytest

from keyfold.operators import newest
from keyfold.plans import changes, state

DIR = "/root/testdata/sf0.001"
ORACLE = {**changes.ORACLE, **state.ORACLE}
QUERIES = {**changes.QUERIES, **state.QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def _plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else int(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*cols).collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    r = duck.execute(ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert got == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_read_filters_in_the_scan(spark):
    p = _plan(state.kv_point_get(spark, DIR))
    assert "EqualTo(key,cfg:gateway/limits)" in p


def test_no_query_holds_all_rows_against_all(spark):
    for name in ("ring_owner", "ring_owners_rf3", "p2_found", "p3_found", "entropy_pull", "read_first_owner"):
        p = _plan(QUERIES[name](spark, DIR))
        assert "CartesianProduct" not in p and "NestedLoop" not in p, name


def test_newest_first_drops_resolved_keys_before_it_folds(spark):
    rows = spark.range(5).selectExpr("cast(id as string) as __k", "false as __none", "struct(id) as w")
    p = _plan(newest.unresolved(rows, rows, True)).splitlines()
    at = lambda what: [i for i, x in enumerate(p) if what in x]
    assert "BroadcastHashJoin" in p[at("LeftAnti")[0]] and at("LeftAnti")[0] > at("Aggregate")[-1]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        q = _plan(newest.unresolved(rows, rows, False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert q.index("LeftAnti") < q.index("Aggregate")


def _exchanges(df) -> list[str]:
    """The subtree of each shuffle of the plan before it ran."""
    lines = _plan(df).split("Initial Plan")[-1].splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    out = []
    for i, line in enumerate(lines):
        if " Exchange " in line:
            end = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_snapshots_move_hashes_once(spark):
    found = _exchanges(changes.p5_found(spark, DIR))
    assert len(found) == 1
    moved = next(x for x in found[0].splitlines() if "MapInArrow" in x)
    assert "key#" in moved and "k1#" in moved and "value#" not in moved
