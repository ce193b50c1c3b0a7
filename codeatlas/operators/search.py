"""Six-tier ranked search and browsing over one edition of a code list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, norm_query, norm_text
from ..plans.schema import COLUMNS, ORD


def tier(query: str) -> Column:
    """1-6 by the first rule that holds, null if none: code equal, code starts, label equal, starts, contains, description contains.

    The code is lower-cased only; label and description are normalised like the query.  All matches are
    literal.
    """
    q = F.lit(norm_query(query))
    code, label, description = F.lower("code"), norm_text(F.col("label")), norm_text(F.col("description"))
    return (
        F.when(code == q, 1).when(code.startswith(q), 2).when(label == q, 3).when(label.startswith(q), 4)
        .when(label.contains(q), 5).when(description.contains(q), 6)
    )


def search(df: DataFrame, query: str | None, level: str | None = None, limit: int = 100, ranked: bool = False) -> DataFrame:
    """At most ``limit`` rows, best tier first, ties in the list's order; a blank query browses.

    ``df`` is one edition with its order key.  With ``ranked``, ``tier`` (null when browsing) and ``pos`` from
    1 are added; the window that numbers them sees ``limit`` rows at most.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    rows = df if level is None else df.where(F.col("level") == level)
    if is_blank(query):
        found, order = rows.withColumn("tier", F.lit(None).cast("int")), [ORD]
    else:
        found, order = rows.withColumn("tier", tier(query)).where("tier is not null"), ["tier", ORD]
    top = found.orderBy(*order).limit(limit)
    if not ranked:
        return top.select(*COLUMNS)
    return top.withColumn("pos", F.row_number().over(W.partitionBy().orderBy(*order)).cast("long")).select(*COLUMNS, "tier", "pos")


def entry(df: DataFrame, code: str) -> DataFrame:
    """All rows with exactly this code: case and white space count; none is an empty result."""
    return df.where(F.col("code") == F.lit(code)).select(*COLUMNS)
