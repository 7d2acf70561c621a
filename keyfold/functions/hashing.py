"""64-bit hashes of the data model, all held in signed LONG columns with the unsigned bits.

``key_hash`` is xxHash64 with seed 0. Spark's own ``xxhash64`` function uses seed 42, so the Catalyst
expression is built with the seed that is wanted; where the session has no JVM gateway an Arrow UDF
gives the same bits. ``hex_hash`` is the hash family that other SQL engines can repeat: the first 16
hex digits of SHA-256, which compare as strings exactly like the unsigned numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)
TOMB = 0x5555555555555555
SHARDS, SUBS = 128, 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _catalyst_xx64(col: Column, seed: int) -> Column:
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    args = jvm.java.util.ArrayList()
    args.add(utils.expression(col._jc))
    seq = jvm.scala.jdk.javaapi.CollectionConverters.asScala(args).toSeq()
    return Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, seed)))


def _arrow_xx64(col: Column, seed: int) -> Column:
    def run(values: pa.Array) -> pa.Array:
        raw = values.cast(pa.binary()).to_pylist()
        return pa.array([seed if v is None else _signed(xxhash.xxh64_intdigest(v, seed)) for v in raw], pa.int64())

    return F.arrow_udf(run, "long")(col)


def xx64(col: Column, seed: int = 0, how: str = "auto") -> Column:
    """xxHash64 of a string or binary column; null gives the seed. ``how``: auto, catalyst or arrow."""
    if how != "arrow":
        try:
            return _catalyst_xx64(col, seed)
        except (AttributeError, TypeError):
            if how == "catalyst":
                raise
    return _arrow_xx64(col, seed)


def rotl(col: Column, n: int) -> Column:
    return F.shiftleft(col, n).bitwiseOR(F.shiftrightunsigned(col, 64 - n))


def sha64(col: Column) -> Column:
    """First 64 bits of SHA-256; the hash family that any SQL engine can repeat. Null gives 0."""
    return F.coalesce(hex_to_long(hex_hash(col)), F.lit(0).cast("long"))


FAMILIES = {"xxh64": xx64, "sha64": sha64}


def key_hash(key: Column, family: str = "xxh64") -> Column:
    return FAMILIES[family](key)


def item_hash(kh: Column, ts: Column, node: Column, value: Column, tombstone: Column, family: str = "xxh64") -> Column:
    """Hash of an entry. Null and empty node or payload and a live flag leave no trace in it."""
    zero = F.lit(0).cast("long")
    part = lambda c, n: F.when(F.octet_length(c) > 0, rotl(FAMILIES[family](c), n)).otherwise(zero)
    return (
        kh.bitwiseXOR(rotl(ts, 17))
        .bitwiseXOR(part(node, 31))
        .bitwiseXOR(part(value, 47))
        .bitwiseXOR(F.when(tombstone, F.lit(TOMB).cast("long")).otherwise(zero))
    )


def unsigned_order(h: Column) -> Column:
    """A LONG that sorts as the unsigned value of ``h`` does."""
    return h.bitwiseXOR(F.lit(SIGN).cast("long"))


def shard_of(h: Column) -> Column:
    return h.bitwiseAND(F.lit(SHARDS - 1).cast("long")).cast("int")


def sub_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(SUBS - 1).cast("long")).cast("int")


def unsigned_mod(h: Column, n: int) -> Column:
    """``h`` as an unsigned number modulo any ``n``."""
    if n > 0 and n & (n - 1) == 0:
        return h.bitwiseAND(F.lit(n - 1).cast("long")).cast("int")
    wide = h.cast("decimal(20,0)")
    return F.pmod(F.when(h < 0, wide + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(wide), F.lit(n)).cast("int")


def hex_hash(col: Column) -> Column:
    """First 64 bits of SHA-256 as 16 lower-case hex digits."""
    return F.substring(F.sha2(col.cast("binary"), 256), 1, 16)


def hex_to_long(h: Column) -> Column:
    """16 hex digits to the LONG with the same bits. A negative base makes the number a signed one."""
    return F.conv(h, 16, -10).cast("long")


def long_to_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def _times(x: Column, m: int) -> Column:
    """Low 64 bits of ``x * m``. ANSI mode refuses a product that overflows, so it is put together from
    16-bit limbs of the constant, each product of which stays within 48 bits a half."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned(x, 32)
    mask32 = F.lit(0xFFFFFFFF).cast("long")
    lo_sum, hi_sum = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(4):
        limb = F.lit((m >> (16 * i)) & 0xFFFF).cast("long")
        p, s = low * limb, 16 * i  # p < 2**48
        if s < 32:
            lo_sum = lo_sum + F.shiftleft(p, s).bitwiseAND(mask32)
            hi_sum = hi_sum + F.shiftrightunsigned(p, 32 - s) + (F.shiftleft((high * limb).bitwiseAND(mask32), s).bitwiseAND(mask32))
        else:
            hi_sum = hi_sum + F.shiftleft(p.bitwiseAND(mask32), s - 32).bitwiseAND(mask32)
    hi_sum = (hi_sum + F.shiftrightunsigned(lo_sum, 32)).bitwiseAND(mask32)
    return F.shiftleft(hi_sum, 32).bitwiseOR(lo_sum.bitwiseAND(mask32))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once however often ``f`` names it; keeps the expression from growing at each step."""
    return F.transform(F.array(x), f)[0]


def mix_count(n: Column) -> Column:
    """Finaliser that folds an item count into a digest, so that an empty bucket never looks like a full one."""
    fold = lambda x, n: _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))
    times = lambda x, m: _let(x, lambda v: _times(v, m))
    # Fixed values of the count mixer.
    x = times(fold(n.cast("long") + 1, 30), 0xBF58476D1CE4E5B9)
    return fold(times(fold(x, 27), 0x94D049BB133111EB), 31)


# Fixed values of the xxHash64 specification.
_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_P4, _P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)


def _np_rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def np_xx64_longs(*cols: np.ndarray, seed: int = 42) -> np.ndarray:
    """What ``F.xxhash64`` gives for LONG columns without nulls, for arrays of their bits."""
    h = np.full(len(cols[0]), seed, np.uint64)
    with np.errstate(over="ignore"):
        for c in cols:
            v = c.astype(np.int64).view(np.uint64)
            h = h + _P5 + np.uint64(8)
            h = h ^ (_np_rotl(v * _P2, 31) * _P1)
            h = _np_rotl(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)
