"""Mutations received as encoded messages, one per row; anything that isn't one is dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.sources.wire import CorruptLog, decode_entry


def decoded(messages: DataFrame, column: str = "bytes") -> DataFrame:
    """``op, key, value, ts, node_id`` of every message that can be read; batch or streaming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(0).to_pylist():
                try:
                    if m:
                        rows.append(decode_entry(m))
                except CorruptLog:
                    pass
            if rows:
                cols = zip(*rows, strict=True)
                kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["op", "key", "value", "ts", "node_id"])

    return messages.select(F.col(column).cast("binary").alias("b")).mapInArrow(run, "op string, key string, value binary, ts long, node_id string")
