"""Session, table and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder that goes away with the process;
    on a cluster that would lose data with a machine, so there it is an error.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if told:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(told)
        return told.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="keyfold-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir("file://" + own)
    # Spark appends a folder of its own to the one that was set.
    return os.path.dirname(sc.getCheckpointDir().rstrip("/"))


_given: list[str] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    _given.append(f"{shared_dir(spark)}/keyfold/{what}-{uuid.uuid4().hex[:12]}")
    return _given[-1]


def sweep(spark: SparkSession) -> None:
    """Delete all that this process has put below the paths that ``shared_path`` gave it, once no result that reads from there is needed."""
    from keyfold.sources.files import delete

    while _given:
        delete(spark, _given.pop())


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, so that its later uses survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
