"""The binary segment log as a data source: ``spark.read.format("keyfold_log")`` and ``df.write.format("keyfold_log")``.

A log is a folder of files ``segment-NNN-TIME-SLICE-*.log``; one file is one partition. Within a segment the names sort in the order of
arrival: by the time of the append, then by its slices of ``seq``, into which a segment that holds much is cut. A path with a scheme
(``hdfs://``, ``s3://``...) is opened through Arrow's file systems; one without is a folder that all executors have mounted.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keyfold.functions.hashing import key_hash, unsigned_mod
from keyfold.sources import wire

SCHEMA = "seq long, op string, key string, value binary, ts long, node_id string, segment int"
#: Rows that a slice of an append holds on average over all segments.
SLICE_ROWS = 500_000
#: Entries that a reader hands over at a time.
BATCH_ROWS = 8192
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ENTRY_TYPES = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
_NAME = re.compile(r"segment-(\d+)-.*\.log\Z")


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if path.startswith("file:"):
        path = urlparse(path).path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Segment(InputPartition):
    name: str
    number: int
    first: int


class LogReader(DataSourceReader):
    """Option ``path``; ``offsets`` (``segment:bytes,...``) skips what a snapshot covers; ``mode`` ``strict`` raises on a
    damaged file, ``permissive`` ends that file there."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.strict = options.get("mode", "strict") == "strict"
        self.skip = {int(s): int(n) for s, n in (x.split(":") for x in options.get("offsets", "").split(",") if x)}

    def partitions(self) -> list[InputPartition]:
        fs, root = _place(self.path)
        names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if _NAME.match(f.base_name))
        # Room for 2**40 entries a file, so that seq rises within a file and never repeats between files.
        return [Segment(n, int(_NAME.match(n)[1]), i << 40) for i, n in enumerate(names)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        first, rows = partition.first, []

        def batch() -> pa.RecordBatch:
            seqs = pa.array(range(first, first + len(rows)), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY_TYPES, strict=True)]
            return pa.record_batch([seqs, *cols, pa.array([partition.number] * len(rows), pa.int32())], names=_COLUMNS)

        fs, root = _place(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            f.seek(self.skip.get(partition.number, 0))
            try:
                for body in wire.frames(f):
                    rows.append(wire.decode_entry(body))
                    if len(rows) == BATCH_ROWS:
                        yield batch()
                        first, rows = first + len(rows), []
            except wire.CorruptLog:
                if self.strict:
                    raise
        if rows:
            yield batch()


def _entries(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[tuple]:
    """``segment, slice, op, key, value, ts, node_id`` of every row; a frame without slices has one."""
    for b in batches:
        have = b.schema.names
        cols = [b.column(have.index(c)).to_pylist() for c in ("op", "key", "value", "ts", "node_id")]
        parts = b.column(have.index("slice")).to_pylist() if "slice" in have else [0] * b.num_rows
        for part, op, key, value, ts, node in zip(parts, *cols, strict=True):
            yield xxhash.xxh64_intdigest((key or "").encode()) % segments, part, op, key, value, ts, node


@dataclass
class Wrote(WriterCommitMessage):
    files: list[tuple[str, str]]


class LogWriter(DataSourceArrowWriter):
    """Options ``path`` and ``segments`` (16). Each task writes hidden files, which the commit renames; a retry leaves none behind."""

    def __init__(self, options: dict):
        self.path, self.segments = options["path"], int(options.get("segments", 16))
        self.began = time.time_ns()  # on the driver, once for an append

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        open_: dict[tuple[int, int], tuple] = {}
        try:
            for s, part, *entry in _entries(batches, self.segments):
                if (s, part) not in open_:
                    name = f"segment-{s:03d}-{self.began:020d}-{part:06d}-{uuid.uuid4().hex}.log"
                    hidden = f"{root}/.{name}"
                    open_[s, part] = (fs.open_output_stream(hidden), hidden, f"{root}/{name}")
                open_[s, part][0].write(wire.frame(wire.encode_entry(*entry)))
        finally:
            for f, hidden, _ in open_.values():
                f.close()
                if isinstance(fs, pafs.LocalFileSystem):
                    with open(hidden, "rb") as there:
                        os.fsync(there.fileno())
        return Wrote([(h, n) for _, h, n in open_.values()])

    def commit(self, messages: list[Wrote | None]) -> None:
        for m in messages:
            for hidden, name in m.files if m else ():
                _place(self.path)[0].move(hidden, name)

    def abort(self, messages: list[Wrote | None]) -> None:
        for m in messages:
            for hidden, _ in m.files if m else ():
                fs = _place(self.path)[0]
                if fs.get_file_info(hidden).type == pafs.FileType.File:
                    fs.delete_file(hidden)


class SegmentLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyfold_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LogWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known. Spark looks it up in the session that is active in the JVM thread at hand, which need not be any."""
    spark.dataSource.register(SegmentLog)
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)


def append(log: DataFrame, path: str, segments: int = 16, slice_rows: int = SLICE_ROWS) -> None:
    """Write log rows in the order of ``seq``. A key has one segment; of a long log a segment is cut by ``seq``, so that a
    key that makes up much of it is written by many tasks and still read back in order."""
    register(log.sparkSession)
    lo, hi, n = log.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    slices = max(1, (n or 0) // slice_rows)
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // slices))
    segment = unsigned_mod(key_hash(F.coalesce("key", F.lit(""))), segments)
    rows = log.select("op", "key", "value", "ts", "node_id", "seq", segment.alias("segment"), F.coalesce(F.expr(f"cast((seq - {lo or 0}L) div {width}L as int)"), F.lit(0)).alias("slice"))
    spread = rows.repartition(segments * slices, "segment", "slice").sortWithinPartitions("segment", "slice", "seq")
    spread.select("op", "key", "value", "ts", "node_id", "slice").write.format("keyfold_log").option("path", path).option("segments", segments).mode("append").save()


def read(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    register(spark)
    return spark.read.format("keyfold_log").option("path", path).option("mode", mode).load()
