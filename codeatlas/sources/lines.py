"""Rows of text files numbered by their position, whatever their number and however the files are split.

A line's place in its split comes from the order in which a task reads it; the lines of the splits before it in its file are
counted once, a row a split.  No task sees more than its own splits and no line is sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sheet import SheetError
from .artifact import ArtifactMissing

#: Splits whose counts may be broadcast: a few dozen bytes each.
BROADCAST_SPLITS = 100_000
_SPLIT = ["file", "block_start"]
#: A quote in a quoted cell is doubled.
_CSV = {"escape": '"'}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, before_file, value`` of every line of the text files at ``path``.

    Numbers count from 1 in each file; ``before_file`` lines are in the files before it, in order of their paths.
    """
    try:
        text = spark.read.text(path)
    except AnalysisException as e:
        raise ArtifactMissing(f"Sheet not found at '{path}'.") from e
    # a task reads the lines of a split in order, so the difference to the split's first number is the place in the split
    read = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("seen"), "value")
    splits = read.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first"))
    earlier = F.sum("n").over(W.partitionBy("file").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1))
    # a row a file comes to the driver
    seen, rows, many = 0, [], 0
    for r in sorted(splits.groupBy("file").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("splits")).collect()):
        rows.append((r["file"], seen))
        seen, many = seen + r["n"], many + r["splits"]
    files = spark.createDataFrame(rows, "file string, before_file long")
    splits = splits.select(*_SPLIT, "first", F.coalesce(earlier, F.lit(0)).alias("before")).join(F.broadcast(files), "file")
    found = read.join(F.broadcast(splits) if many <= BROADCAST_SPLITS else splits, _SPLIT)
    return found.select("file", (F.col("before") + F.col("seen") - F.col("first") + 1).alias("line_no"), "before_file", "value")


def read_numbered_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A sheet saved as CSV: ``row_no``, the line of the file that a row stands on, and ``columns`` as text.

    Columns are found by their names in the first line, in whatever order.  Empty lines are no rows but count as lines; a cell holds no line end.  Several
    files are parts of one sheet in order of their paths, each with the header; lines are counted through them.
    """
    lines = numbered_lines(spark, path)
    header = lines.where("line_no = 1").select("file", "value").orderBy("file").first()
    if header is None:
        raise SheetError("Sheet has no rows")
    names = [c or "" for c in _cells(spark, header["value"])]
    missing = [c for c in columns if c not in names]
    if missing:
        raise SheetError(f"Sheet is missing column(s): {', '.join(missing)}")
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = lines.where("line_no > 1 and length(trim(value)) > 0").select((F.col("before_file") + F.col("line_no")).alias("row_no"), F.from_csv("value", F.lit(cells), _CSV).alias("x"))
    return parsed.select("row_no", *[F.col(f"x.c{names.index(c)}").alias(c) for c in columns])


def _cells(spark: SparkSession, line: str) -> list[str]:
    """The cells of one line, by the parser that reads the others."""
    n = line.count(",") + 1
    schema = ", ".join(f"c{i} string" for i in range(n))
    found = spark.createDataFrame([(line,)], "value string").select(F.from_csv("value", F.lit(schema), _CSV).alias("x")).first()["x"]
    cells = list(found)
    while len(cells) > 1 and cells[-1] is None:
        cells.pop()
    return cells
