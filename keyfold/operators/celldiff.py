"""Differences between two copies of a table, field by field, by signed counts of key-field-value cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.session import cut

ONLY_A, ONLY_B = "only_a", "only_b"
#: Number of the cell that says that a key is there.
PRESENT = -1


#: Types whose values stand for themselves; of all others 128 bits of hash are compared and moved.
PLAIN = {"boolean", "tinyint", "smallint", "int", "bigint"}


def _field(df: DataFrame, name: str) -> Column:
    """What of the field is compared; null stays null and so differs from an empty value. Payloads are hashed where they are read."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind in PLAIN:
        return c.cast("bigint")
    if kind.startswith(("struct", "array", "map")):
        c = F.to_json(F.struct(c))
    return F.when(F.col(name).isNotNull(), F.struct(F.xxhash64(F.lit(1), c).alias("x"), F.xxhash64(F.lit(2), c).alias("y")))


def _cell(rows: DataFrame, name: str) -> Column:
    """A field of ``_rows`` in the form that the cells of all fields have in common."""
    return F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("x"), F.lit(0).cast("bigint").alias("y"))) if dict(rows.dtypes)[name] == "bigint" else F.col(name)


def _rows(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key``, a cell ``f0``, ``f1``... for each field, and how often the row is in copy a (``a``) and in copy b (``b``)."""
    side = lambda df, x, y: df.select(F.col(key).alias("key"), *(_field(df, f).alias(f"f{i}") for i, f in enumerate(fields)), F.lit(x).alias("a"), F.lit(y).alias("b"))
    one, none = 1, 0
    both = side(a, one, none).unionByName(side(b, none, one))
    return both.groupBy("key", *(f"f{i}" for i in range(len(fields)))).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _counts(rows: DataFrame, fields: list[str], whole: bool) -> DataFrame:
    """``key, field, a, b``: of each cell the counts in either copy. Unless ``whole``, rows that both copies hold give
    only the cell that says that the key is there, with a count of 1 in ``alike``."""
    present = F.struct(F.lit(PRESENT).alias("field"), F.lit(None).cast("struct<x:bigint,y:bigint>").alias("cell"))
    every = F.array(present, *(F.struct(F.lit(i).alias("field"), _cell(rows, f"f{i}").alias("cell")) for i in range(len(fields))))
    alike = (F.col("a") > 0) & (F.col("b") > 0)
    cells = rows.select("key", "a", "b", alike.cast("int").alias("alike"), F.explode(every if whole else F.when(alike, F.array(present)).otherwise(every)).alias("c"))
    return cells.groupBy("key", "c.field", "c.cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("alike").alias("alike"), F.count("*").alias("n")).drop("cell")


def _verdicts(counts: DataFrame, fields: list[str]) -> DataFrame:
    """``key``, ``only`` (the side that alone has it, or 0), ``mixed`` and whether each field differs.

    A cell counts once for a copy, however many of its rows hold it; it is cancelled if the signs of both copies add up to 0.
    ``mixed``: some rows of the key are alike in both copies and some aren't."""
    net = F.signum("a") - F.signum("b")
    of_key = F.col("field") == PRESENT
    return counts.groupBy("key").agg(
        F.max(F.when(of_key, net)).alias("only"), F.coalesce(F.max(of_key & (F.col("alike") > 0) & (F.col("alike") < F.col("n"))), F.lit(False)).alias("mixed"),
        *(F.max((F.col("field") == i) & (net != 0)).alias(f"d{i}") for i in range(len(fields))),
    )


def copy_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, diff``: ``only_a`` or ``only_b`` for a key in one copy, else one row for each field that differs.

    Both copies are unpivoted to key-field-value cells, those of copy a counted with a plus and those of b with a minus,
    identical cells of one copy counting once; a cell whose signs don't cancel is a difference. Where a key has
    several different rows in a copy, a field therefore differs if the sets of its values differ.

    Before that, rows that both copies hold alike cancel as a whole, so that only rows which differ somewhere are
    multiplied by the number of fields; of the others only the cell goes on that says the key is there. That is the same as
    long as no key has rows of either kind. Keys that have, if there are any, are unpivoted again with all their rows.

    Nulls equal each other and nothing else, in the key as well. Fields of any type; an empty copy makes every key
    one-sided. Columns besides ``key`` and ``fields`` are not read. Values are compared by 128 bits of hash. Every step is an
    aggregation that combines before its shuffle; keyed by row, by cell and by key in turn, they spread a key that holds much
    of a copy, in copies of one row or in many different ones.
    """
    rows = _rows(a, b, key, fields)
    odd = cut(_verdicts(_counts(rows, fields, False), fields).where(" or ".join(["only != 0", "mixed", *(f"d{i}" for i in range(len(fields)))])))
    verdicts = odd.where("not mixed")
    if not odd.where("mixed").isEmpty():
        again = rows.join(odd.where("mixed").select(F.col("key").alias("__key")), F.col("key").eqNullSafe(F.col("__key")), "left_semi")
        verdicts = verdicts.unionByName(_verdicts(_counts(again, fields, True), fields))
    found = F.when(F.col("only") > 0, F.array(F.lit(ONLY_A))).when(F.col("only") < 0, F.array(F.lit(ONLY_B))).otherwise(
        F.filter(F.array(*(F.when(F.col(f"d{i}"), F.lit(f)) for i, f in enumerate(fields))), lambda x: x.isNotNull())
    )
    return verdicts.select("key", F.explode(found).alias("diff"))


def difference_summary(diffs: DataFrame) -> DataFrame:
    """``diff, keys``: how many keys show each kind of difference."""
    return diffs.groupBy("diff").agg(F.count("*").alias("keys"))
