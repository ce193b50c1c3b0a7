"""The canonical code-list relation: ten string columns and an order key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the relation, which of them may be null, the status domain; the texts of errors below are fixed too.
NULLABLE = {"description", "parent_code", "source_url"}
COLUMNS = ["system", "version", "level", "code", "label", "description", "parent_code", "status", "source", "source_url"]
REQUIRED = ["system", "version", "level", "code", "label", "status", "source"]
STATUSES = ["current", "archived"]
CANONICAL = T.StructType([T.StructField(c, T.StringType(), c in NULLABLE) for c in COLUMNS])
#: The order key of a list: sortable, deterministic from the source's own keys, not necessarily dense.
ORD = "ord"
STORED = T.StructType([*CANONICAL.fields, T.StructField(ORD, T.LongType(), False)])


class SchemaError(ValueError):
    """A relation that breaks the canonical contract."""


def conform(df: DataFrame, ord: Column | None = None, **constants: str | Column | None) -> DataFrame:
    """The ten columns in order, cast to string, and ``ord`` if given.

    A column comes from ``constants`` (a literal, or a Column), else from ``df``; a nullable one that neither
    has is null.
    """

    def column(name: str) -> Column:
        if name in constants:
            given = constants[name]
            return given if isinstance(given, Column) else F.lit(given)
        if name in df.columns:
            return F.col(name)
        if name in NULLABLE:
            return F.lit(None)
        raise SchemaError(f"Classification data missing required column(s): {name}")

    out = [column(c).cast("string").alias(c) for c in COLUMNS]
    return df.select(*out, *([ord.cast("long").alias(ORD)] if ord is not None else []))


def build(spark: SparkSession, code: Sequence, **columns) -> DataFrame:
    """From lists: a column of length one is repeated to the length of ``code``; ``ord`` is the position."""
    n, data = len(code), {}
    for c in COLUMNS:
        given = code if c == "code" else columns.get(c)
        values = list(given) if isinstance(given, (list, tuple)) else [given]
        if len(values) not in (1, n):
            raise SchemaError(f"Column '{c}' has length {len(values)}, expected 1 or {n}")
        values = values * n if len(values) == 1 else values
        data[c] = [None if v is None else str(v) for v in values]
    rows = [(*r, i) for i, r in enumerate(zip(*(data[c] for c in COLUMNS), strict=True))]
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in STORED.fields])
    out = spark.createDataFrame(rows, loose)
    validate(out)
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """One row: how many nulls each required column has."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED])


def bad_statuses(df: DataFrame) -> DataFrame:
    """One row: the statuses outside the domain, sorted."""
    bad = F.when(~F.col("status").isin(*STATUSES), F.col("status"))
    return df.agg(F.array_join(F.array_sort(F.collect_set(bad)), ", ").alias("bad_statuses"))


def check_columns(df: DataFrame) -> None:
    """Raises on missing columns, then on other types: what the schema alone tells."""
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise SchemaError(f"Classification data missing required column(s): {', '.join(missing)}")
    other = [c for c in COLUMNS if df.schema[c].dataType != T.StringType()]
    if other:
        raise SchemaError(f"Classification column(s) must be character: {', '.join(other)}")


def null_error(column: str) -> SchemaError:
    return SchemaError(f"Classification column '{column}' must not contain NA")


def status_error(bad: Sequence[str]) -> SchemaError:
    return SchemaError(f"Classification status must be 'current' or 'archived', got: {', '.join(sorted(bad))}")


def observed_rules() -> list[Column]:
    """Aggregates that tell of broken rules, for one pass over the data or for an observation of it."""
    return [*[F.bool_or(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED], F.collect_set(F.when(~F.col("status").isin(*STATUSES), F.col("status"))).alias("bad")]


def check_rules(seen: Mapping) -> None:
    """Raises at the first broken rule of what ``observed_rules`` gave: nulls by column, then the status domain."""
    for c in REQUIRED:
        if seen[f"null_{c}"]:
            raise null_error(c)
    if seen["bad"]:
        raise status_error(seen["bad"])


def validate(df: DataFrame) -> None:
    """Raises at the first broken rule: missing columns, types, nulls, status domain.

    The first two look at the schema only; the others take one pass over the data.
    """
    check_columns(df)
    check_rules(df.agg(*observed_rules()).first().asDict())
