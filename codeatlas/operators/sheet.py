"""A sparse sheet, one column per level, as a long hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class SheetError(ValueError):
    """A sheet that cannot be parsed, or whose counts are wrong."""


def check_sheet(df: DataFrame, columns: Sequence[str], row_col: str = "row_no", label_col: str = "description") -> None:
    """Fails on missing columns, an empty sheet, or a null description, naming the first such row."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SheetError(f"Sheet is missing column(s): {', '.join(missing)}")
    n, bad = df.agg(F.count(F.lit(1)), F.min(F.when(F.col(label_col).isNull(), F.col(row_col)))).first()
    if not n:
        raise SheetError("Sheet has no rows")
    if bad is not None:
        raise SheetError(f"Row {bad} has no description")


def parse_wide_sheet(
    df: DataFrame, levels: Sequence[str], row_col: str = "row_no", label_col: str = "description", sheet_col: str | None = None,
    names: Mapping[str, str] | None = None, block: int = 100_000,
) -> DataFrame:
    """``ord, level, code, label, parent_code``, one row per filled level cell.

    A record's parent is the nearest higher level that has a code, on its row or the last one seen above it,
    however old.  Last values are carried in two passes: over blocks of ``block`` row numbers, then within
    them, so that one large sheet is no single task.  ``names`` renames level columns.
    """
    scope = [sheet_col] if sheet_col else []
    rows = df.withColumn("__block", F.floor(F.col(row_col) / F.lit(block)))
    last = rows.groupBy(*scope, "__block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row_col))).alias(f"__last_{c}") for c in levels])
    earlier = W.partitionBy(*scope).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*scope, "__block", *[F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__before_{c}") for c in levels])
    inside = W.partitionBy(*scope, "__block").orderBy(row_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = rows.join(carried, [*scope, "__block"], "left")
    filled = filled.select("*", *[F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__before_{c}")).alias(f"__ff_{c}") for c in levels])
    cells = []
    for i, c in enumerate(levels):
        above = [F.col(f"__ff_{x}") for x in reversed(levels[:i])]
        parent = F.coalesce(*above) if above else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(i).alias("i"), F.lit((names or {}).get(c, c)).alias("level"), F.col(c).alias("code"), parent.alias("parent_code")))
    long = filled.select(*scope, F.col(row_col).alias("__row"), F.col(label_col).alias("label"), F.explode(F.array(*cells)).alias("x")).where("x.code is not null")
    return long.select(*scope, (F.col("__row") * 10 + F.col("x.i")).cast("long").alias("ord"), "x.level", "x.code", "label", "x.parent_code")


def level_counts(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """``level, n`` for each of ``levels``, zero where there are none, in one pass."""
    counted = df.agg(*[F.count_if(F.col("level") == lv).alias(lv) for lv in levels])
    pairs = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(f"`{lv}`").alias("n")) for lv in levels])
    return counted.select(F.explode(pairs).alias("x")).select("x.level", "x.n")


def reconcile(counts: DataFrame, stated: DataFrame) -> DataFrame:
    """``level, parsed, stated, result``: PASS, or a warning where they differ."""
    both = counts.join(stated.withColumnRenamed("n", "stated"), "level")
    result = F.when(F.col("n") == F.col("stated"), "PASS").otherwise("WARN (documented discrepancy)")
    return both.select("level", F.col("n").alias("parsed"), "stated", result.alias("result"))


def require_counts(reconciled: DataFrame, soft: Sequence[str] = ()) -> list[str]:
    """Raises on a level whose count differs, unless it is in ``soft``; those come back as warnings.  A row per level."""
    warnings = []
    for r in reconciled.where("parsed <> stated").orderBy("level").collect():
        text = f"Parsed {r['level']} count ({r['parsed']}) does not match the stated count ({r['stated']})"
        if r["level"] not in soft:
            raise SheetError(f"{text} and this is not a documented exception. Aborting build.")
        warnings.append(text)
    return warnings


def require_codes(df: DataFrame, label: str, levels: Sequence[str], codes: Sequence[str]) -> None:
    """Raises unless the entries with exactly this label in these levels have at least these codes."""
    found = df.where((F.col("label") == F.lit(label)) & F.col("level").isin(*levels) & F.col("code").isin(*codes))
    there = {r["code"] for r in found.select("code").distinct().collect()}
    missing = [c for c in codes if c not in there]
    if missing:
        raise SheetError(f"Sanity check failed: '{label}' has no code(s) {', '.join(missing)}")
