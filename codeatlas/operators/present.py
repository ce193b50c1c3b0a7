"""Pages, detail cards and badges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.collation import by_language
from ..functions.labels import badge_label, badge_style
from ..plans.schema import ORD

#: Columns of a results page that a reader may sort by.
DISPLAY = ("Code", "Label", "Level", "Status")


def display_page(df: DataFrame, page: int = 0, size: int = 15, sort: str | None = None, descending: bool = False, contains: str | None = None, collation: str | None = None) -> DataFrame:
    """One page of ``Code, Label, Level, Status`` in the list's order, or sorted by one of them, by code point or a collation; ``contains`` filters all four.

    It sorts or skips what comes before; ``search_index`` has pages that don't.
    """
    shown = df.select(*[F.col(c.lower()).alias(c) for c in DISPLAY], ORD)
    if contains:
        hit = F.lit(False)
        for c in DISPLAY:
            hit = hit | F.lower(c).contains(contains.lower())
        shown = shown.where(hit)
    if sort is not None and sort not in DISPLAY:
        raise ValueError(f"Unsupported column '{sort}'. Available columns: {', '.join(DISPLAY)}")
    first = [] if sort is None else [c.desc() if descending else c for c in by_language(F.col(sort), collation)]
    return shown.orderBy(*first, ORD).offset(page * size).limit(size).select(*DISPLAY)


def select_by_position(df: DataFrame, position: int | None, limit: int = 200) -> DataFrame:
    """The row at a position from 1 of the first ``limit`` rows; none selected or out of range is empty."""
    top = df.orderBy(ORD).limit(limit)
    if position is None:
        return top.limit(0)
    return top.withColumn("__pos", F.row_number().over(W.partitionBy().orderBy(ORD))).where(F.col("__pos") == position).drop("__pos")


def entry_detail(df: DataFrame) -> DataFrame:
    """``code, pos, field, value`` rows of each entry's card; a missing URL has no row."""
    # fixed values: the labels of the card, in order
    fields = [
        ("Code", F.col("code")), ("Label", F.col("label")), ("Description", F.coalesce("description", F.lit("Not available"))), ("System", F.upper("system")),
        ("Edition / release", F.col("version")), ("Level", F.col("level")), ("Status", badge_label(F.col("status"))), ("Source", F.col("source")), ("Link", F.col("source_url")),
    ]
    card = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(k).alias("field"), v.alias("value")) for i, (k, v) in enumerate(fields, 1)])
    return df.select("code", F.explode(card).alias("x")).select("code", "x.pos", "x.field", "x.value").where("value is not null or field <> 'Link'")


def status_badge(df: DataFrame) -> DataFrame:
    return df.select("code", "status", badge_label(F.col("status")).alias("badge"), badge_style(F.col("status")).alias("style"))
