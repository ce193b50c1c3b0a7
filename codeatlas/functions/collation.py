"""Order and comparison by language: Spark's collations instead of code points and Java's case.

A collation's name is a language (``de``: as its dictionaries sort), or ``UNICODE`` with what to ignore: ``UNICODE_CI`` case, ``UNICODE_CI_AI``
case and accents.  Collated columns sort, group, join, and match by prefix or part in the JVM's code-generated plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Neither case nor accents count.
LOOSE = "UNICODE_CI_AI"


def by_language(c: Column, collation: str | None) -> list[Column]:
    """Sort keys: the collation's, then code points, so that the order is total; without a collation code points alone."""
    return [c] if collation is None else [F.collate(c, collation), c]


def sorted_labels(df: DataFrame, label: str, language: str, collations: dict[str, str], first: int = 100) -> DataFrame:
    """``language, pos, label``: the ``first`` distinct labels of each language in the order of its collation, from 1.

    Languages without a collation are in the order of code points.  A task passes on ``first`` labels at most.
    """
    if not 0 < first <= 1000:
        raise ValueError("first must be from 1 to 1000")
    out = None
    known = F.col(language).isin(*collations)
    for name, collation in [*collations.items(), (None, None)]:
        rows = df.where(F.coalesce(~known, F.lit(True)) if name is None else F.col(language) == name)
        place = F.row_number().over(W.partitionBy(language).orderBy(*by_language(F.col(label), collation)))
        part = rows.select(language, label).distinct().withColumn("pos", place).where(F.col("pos") <= first)
        out = part if out is None else out.unionByName(part)
    return out.select(language, F.col("pos").cast("long").alias("pos"), label)


def spelled_alike(df: DataFrame, label: str, collation: str = LOOSE) -> DataFrame:
    """``label, spellings, n``: labels that differ in what the collation ignores, under the first of them by code point."""
    counted = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.groupBy(F.collate(F.col(label), collation).alias("__key"))
    return grouped.agg(F.min(label).alias(label), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n")).drop("__key")


def matching(c: Column, text: str, collation: str = LOOSE) -> Column:
    """1, 2 or 3 where ``c`` equals, begins with or contains ``text`` as the collation compares, else null."""
    here = F.collate(c, collation)
    return F.when(here == F.collate(F.lit(text), collation), 1).when(here.startswith(F.collate(F.lit(text), collation)), 2).when(here.contains(F.collate(F.lit(text), collation)), 3)
