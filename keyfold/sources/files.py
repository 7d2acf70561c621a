"""Small control files in a folder shared by all workers, through Hadoop's file systems."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


#: File systems on which a name is given to a file by one caller only.
ATOMIC = ("file", "hdfs", "viewfs")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, body: str) -> bool:
    """Make the file ``path`` whole, or return False because it exists already; never both for two callers.

    The body goes to a hidden file first. On a local disk a hard link gives it its name, on HDFS a rename that refuses to
    overwrite. Other file systems can't promise that only one of two callers succeeds and are an error: leases, delivery
    versions and snapshots must lie on one of these two; data may lie elsewhere.
    """
    fs, p = _fs(spark, path)
    if fs.getScheme() not in ATOMIC:
        raise ValueError(f"files can't be created by one writer alone on {fs.getScheme()}; use one of {', '.join(ATOMIC)}")
    hidden = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    part = spark._jvm.org.apache.hadoop.fs.Path(hidden)
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":
            local = lambda x: urlparse(x).path if x.startswith("file:") else x
            try:
                os.link(local(hidden), local(path))
                return True
            except FileExistsError:
                return False
        jvm = spark._jvm
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        opts = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = none
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration()).rename(part, p, opts)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
    finally:
        fs.delete(part, False)
