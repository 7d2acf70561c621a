"""Queries of the text operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import contamination, mixing, repetition
from keyfold.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where(F.col("run") >= contamination.SPAN).select("doc_id", "item_id")


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with SPAN words in line of which at most REPLACED inner ones differ, and all longer overlaps around seed hits."""
    found = contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where((F.col("overlap") >= contamination.SPAN) | (F.col("replaced") <= contamination.REPLACED)).drop("replaced")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix and how often each is used."""
    docs = table(spark, d, "documents").where("source is not null")  # those without a source are in no mix
    return mixing.mix(mixing.count_tokens(docs), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p7_due(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source has to get of each mix: of all weights, and of those of the sources that are there."""
    return p7_shares(spark, d).select("mix_id", "source", F.round("target_share", 9).alias("target_share"), F.round("due_share", 9).alias("due_share"))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source of each mix keeps its repeats, and is off what is due by no more tokens than the mix's largest document has."""
    m, targets = p7_mix(spark, d), table(spark, d, "mix_targets")
    most = m.groupBy("mix_id").agg(F.max("n").alias("largest"), F.sum(F.col("n") * F.col("copies")).alias("total"))
    limit = targets.groupBy("mix_id", "source").agg(F.max("max_repeats").alias("limit"))
    return mixing.shares(m, targets).join(most, "mix_id").join(limit, ["mix_id", "source"]).select(
        "mix_id", "source", (F.col("most_uses") <= F.col("limit")).alias("within_repeats"),
        (F.abs(F.col("tokens") - F.col("due_share") * F.col("total")) <= F.col("largest")).alias("within_a_document"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents")).select("doc_id")


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated content and the fertility measures of every document."""
    return repetition.repetition(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words and repeated words alone."""
    return p8_share(spark, d).select("doc_id", "words", "repeated")


def p8_fertility(spark: SparkSession, d: str) -> DataFrame:
    """Which documents lie outside the fertility bands of their script."""
    return repetition.fertility_verdicts(repetition.repetition(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p6_found, p6_overlaps, p7_mix, p7_shares, p7_due, p7_limits, p8_found, p8_share, p8_counts, p8_fertility)}
_P8 = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}+'), lambda x: lower(x)) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram FROM t),
r AS (SELECT doc_id, i, len(gram) = 8 AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS again FROM g),
c AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM r),
n AS (SELECT d.doc_id, len(d.w)::INT AS words, coalesce(s.repeated, 0)::INT AS repeated
  FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (covered) AS repeated FROM c GROUP BY doc_id) s USING (doc_id))
"""
ORACLE: dict[str, str] = {
    "p7_due": """
WITH t AS (SELECT mix_id, source, sum(weight) AS w, max(max_repeats) AS r FROM mix_targets GROUP BY ALL),
j AS (SELECT t.*, r > 0 AND source IN (SELECT source FROM documents WHERE length(text) > 0) AS there FROM t)
SELECT mix_id, source, round(w / sum(w) OVER (PARTITION BY mix_id), 9) AS target_share,
  coalesce(round((CASE WHEN there THEN w ELSE 0 END) / sum(CASE WHEN there THEN w ELSE 0 END) OVER (PARTITION BY mix_id), 9), 0) AS due_share FROM j""",
    "p7_limits": "SELECT DISTINCT mix_id, source, TRUE AS within_repeats, TRUE AS within_a_document FROM mix_targets",
    "p8_counts": _P8 + "SELECT doc_id, words, repeated FROM n",
    "p8_found": _P8 + "SELECT doc_id FROM n WHERE words > 0 AND repeated * 10 >= words * 3",
}
