"""The stored code lists: Parquet by system and version, with a JSON sidecar of provenance."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.sheet import SheetError
from ..plans.schema import COLUMNS, ORD, STORED, check_columns, check_rules, observed_rules
from .files import Files
from .files import scratch as scratch


class ArtifactMissing(FileNotFoundError):
    """The stored code lists are not where they should be."""


def write_editions(df: DataFrame, path: str) -> None:
    """Writes canonical rows; only the editions in ``df`` are replaced.

    One job: the rules are observed while the rows are written aside, and nothing is replaced where one is broken.  Readers may see an edition missing
    while it is replaced; ``store.Store`` swaps editions whole.
    """
    check_columns(df)
    files, seen = Files(df.sparkSession, path), Observation()
    aside = f"{path}/_staging-{uuid.uuid4().hex}"
    try:
        df.select(*COLUMNS, ORD).observe(seen, F.count(F.lit(1)).alias("rows"), *observed_rules()).write.partitionBy("system", "version").parquet(aside)
        check_rules(seen.get)
        editions = [f"{s}/{v}" for s in files.names(aside) if "=" in s for v in files.names(f"{aside}/{s}")]
        for edition in editions:
            files.delete(f"{path}/{edition}")
            files.move(f"{aside}/{edition}", f"{path}/{edition}")
    finally:
        files.delete(aside)


def read_editions(spark: SparkSession, path: str) -> DataFrame:
    """All stored editions; filters on system and version prune partitions."""
    try:
        found = spark.read.schema(STORED).parquet(path)
    except AnalysisException as e:
        raise ArtifactMissing(f"Code lists not found at '{path}'. Build them first.") from e
    return found.select(*COLUMNS, ORD)


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    """One JSON object, nested counts included; keys keep their order."""
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except AnalysisException as e:
        raise ArtifactMissing(f"Metadata not found at '{path}'. Build the code lists first.") from e


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of the bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A sheet saved as CSV, every column as text and found by its name in the header, in whatever order."""
    try:
        found = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        raise ArtifactMissing(f"Sheet not found at '{path}'.") from e
    missing = [c for c in columns if c not in found.columns]
    if missing:
        raise SheetError(f"Sheet is missing column(s): {', '.join(missing)}")
    return found.select(*[F.col(f"`{c}`") for c in columns])


def list_editions(spark: SparkSession, path: str) -> DataFrame:
    """``system, version`` of what is stored: names of partitions, no column of the files is read."""
    return read_editions(spark, path).select("system", "version").distinct()


def read_text(spark: SparkSession, path: str, fallback: str = "Not available.") -> str:
    """A text file as one string, or the fallback."""
    try:
        return spark.read.text(path, wholetext=True).first()["value"]
    except AnalysisException:
        return fallback
