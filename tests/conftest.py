from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from keyfold.session import local_session

    s = local_session(4, 4, **{"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    yield s
    s.stop()


LOG = "seq long, op string, key string, value binary, ts long, node_id string"
ENTRIES = "key string, value binary, ts long, node_id string, tombstone boolean"


@pytest.fixture
def log(spark):
    def make(*rows):
        return spark.createDataFrame([(i, op, k, None if v is None else bytearray(v), ts, n) for i, (op, k, v, ts, n) in enumerate(rows, 1)], LOG)

    return make


@pytest.fixture
def entries(spark):
    def make(*rows):
        return spark.createDataFrame([(k, None if v is None else bytearray(v), ts, n, t) for k, v, ts, n, t in rows], ENTRIES)

    return make


def rows(df) -> list[tuple]:
    """Rows as plain tuples in a fixed order."""
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    return sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)
