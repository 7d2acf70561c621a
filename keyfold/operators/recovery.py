"""State from a snapshot and the part of the log that came after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions.hashing import key_hash, unsigned_mod
from keyfold.operators.fold import ENTRY, as_entries, fold


def recover(snapshot: DataFrame, tail: DataFrame, family: str = "xxh64") -> DataFrame:
    """Entries of ``snapshot`` merged with the log rows of ``tail``; overlap between the two does no harm."""
    return fold(snapshot.select(*ENTRY).unionByName(as_entries(tail).select(*ENTRY)), family)


def segmented(log: DataFrame, segments: int = 16, family: str = "xxh64") -> DataFrame:
    """Log rows with the ``segment`` that their key belongs to."""
    return log.withColumn("segment", unsigned_mod(key_hash(F.col("key"), family), segments))


def offsets(log: DataFrame, upto: int) -> DataFrame:
    """What a snapshot captures of the log before it reads: per segment the last ``seq`` written."""
    return log.where(F.col("seq") <= upto).groupBy("segment").agg(F.max("seq").alias("offset"))


def clear(log: DataFrame, captured: DataFrame | None) -> DataFrame:
    """The log without the prefix that a snapshot covers; all of it goes where no offsets are given.

    ``captured`` has one row for each segment. Segments without an offset keep everything.
    """
    if captured is None:
        return log.limit(0)
    return log.join(captured, "segment", "left").where(F.col("offset").isNull() | (F.col("seq") > F.col("offset"))).drop("offset")
