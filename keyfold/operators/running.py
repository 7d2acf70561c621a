"""Running aggregates that don't gather a hot group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the order within which a group is sorted, at least; a group of a third of all rows falls into this many tasks.
#: There are more where a slice would have more than SLICE_ROWS of all rows, up to MOST_SLICES, whose sums still sort in one task.
SLICES, SLICE_ROWS, MOST_SLICES = 64, 4_000_000, 1_000_000


def running(
    df: DataFrame, by: list[str], order: str, value: Column, name: str, fold: Callable[[Column], Column], inclusive: bool = False, slices: int | None = None,
    bounds: tuple[int | None, int | None, int] | None = None,
) -> DataFrame:
    """``df`` with ``name``: ``fold`` of ``value`` over the rows of the same ``by`` that come earlier in ``order``.

    ``order`` is a unique LONG (or micros of a time); ``inclusive`` takes in the row itself. ``fold`` must be
    associative, such as max, min or sum. Each group is cut into ``slices`` equal ranges of ``order`` (by default as many as the rows
    need); rows are sorted within a slice and what a slice leaves to later ones is one row. Nulls in ``by`` are one group; a null
    ``order`` comes first, in a slice of its own. ``bounds``: see ``bounds_of``; without them the input is read once more for them.
    """
    lo, hi, n = bounds or bounds_of(df, order)
    slices = slices or max(SLICES, min(MOST_SLICES, n // SLICE_ROWS))
    width = 1 if lo is None else max(1, -(-(hi - lo + 1) // slices))
    keys = [f"__b{i}" for i in range(len(by))]
    d = df.withColumn("__v", value).withColumn("__s", F.coalesce(F.expr(f"({order} - ({lo or 0}L)) div {width}L"), F.lit(-1).cast("long")))
    for k, b in zip(keys, by, strict=True):
        # Text of the group's name, so that groups of null join like all others.
        d = d.withColumn(k, F.coalesce(F.concat(F.lit("="), F.col(b).cast("string")), F.lit("")))
    inner = Window.partitionBy(*keys, "__s").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = d.withColumn("__in", fold(F.col("__v")).over(inner))
    # One row a slice, at most `slices` + 1 a group.
    outer = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(*keys, "__s").agg(fold(F.col("__v")).alias("__all")).select(*keys, "__s", fold(F.col("__all")).over(outer).alias("__before"))
    joined = within.join(before, [*keys, "__s"])
    return joined.withColumn(name, combine(fold, F.col("__in"), F.col("__before"))).drop("__v", "__s", "__in", "__before", *keys)


def bounds_of(df: DataFrame, order: str) -> tuple[int | None, int | None, int]:
    """Least and greatest ``order`` and the number of rows, for several running aggregates over the same rows."""
    return tuple(df.agg(F.min(order), F.max(order), F.count("*")).first())


def combine(fold: Callable[[Column], Column], a: Column, b: Column) -> Column:
    """``fold`` of two values, of which either may be null."""
    kind = fold.__name__
    if kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    if kind not in ("max", "min"):
        raise ValueError(f"can't combine {kind}")
    first = (a >= b) if kind == "max" else (a <= b)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(first, a).otherwise(b)
