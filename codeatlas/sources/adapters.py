"""Adapters: how raw code lists become canonical editions.

An adapter's own ``get`` filters by level without asking whether there is such a level; the service validates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import fill_missing_label
from ..operators.hierarchy import parent_by_prefix, parent_by_zero_suffix
from ..plans.schema import ORD, conform


class Adapter(Protocol):
    """What the service and the catalog ask of a source.  ``versions`` may be empty, any call may raise while the data is missing."""

    system: str
    source: str
    source_url: str | None

    @property
    def versions(self) -> Sequence[str]: ...

    def status(self, version: str) -> str: ...

    def list_levels(self, version: str) -> list[str]: ...

    def edition(self, version: str) -> DataFrame: ...

    def get(self, version: str, level: str | None = None) -> DataFrame: ...

    def metadata(self, version: str) -> dict: ...


class _Reading:
    """``get`` and ``metadata`` by means of ``edition`` and ``status``."""

    def get(self, version: str, level: str | None = None) -> DataFrame:
        """All levels, or one; a level that isn't there is an empty result."""
        df = self.edition(version)
        return df if level is None else df.where(df.level == level)

    def metadata(self, version: str) -> dict:
        return {"system": self.system, "version": version, "display_version": version, "status": self.status(version), "source": self.source, "source_url": self.source_url}


def union_levels(pulls: Mapping[str, DataFrame], levels: list[str]) -> DataFrame:
    """``level, code, label, description, ord`` of one pull per level, top level first, each in its own order.

    A pull has ``value, label`` and ``ord`` (below 2**40), perhaps ``description``; one without has null
    for each of its rows.
    """
    out = None
    for i, lv in enumerate(levels):
        raw = pulls[lv]
        description = F.col("description") if "description" in raw.columns else F.lit(None)
        part = raw.select(
            F.lit(lv).alias("level"), F.col("value").cast("string").alias("code"), F.col("label").cast("string").alias("label"),
            description.cast("string").alias("description"), (F.lit(i << 40) + F.col("ord")).cast("long").alias(ORD),
        )
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class LevelSource(_Reading):
    """A system that is read level by level, one edition at a time; parents are longest prefixes.

    ``pull(version, level_arg)`` reads one level; ``level_args`` maps level ids to the source's names.
    """

    system: str
    versions: tuple[str, ...]
    levels: tuple[str, ...]
    pull: Callable[[str, str], DataFrame]
    status: Callable[[str], str]
    source: str
    source_url: str | None = None
    level_args: Mapping[str, str] = field(default_factory=dict)

    def edition(self, version: str) -> DataFrame:
        pulls = {lv: self.pull(version, self.level_args.get(lv, lv)) for lv in self.levels}
        rows = union_levels(pulls, list(self.levels))
        rows = rows.withColumn("label", fill_missing_label(F.col("label"), F.col("description"), F.col("code")))
        rows = rows.withColumn("system", F.lit(self.system)).withColumn("version", F.lit(version))
        return _canonical(parent_by_prefix(rows, self.levels), self, version, F.col(ORD))

    def list_levels(self, version: str) -> list[str]:
        return list(self.levels)


@dataclass(frozen=True)
class ReleaseSource(_Reading):
    """A system read as whole releases of zero-padded codes; parents have more trailing zeros.

    ``pull(version)`` gives ``code, label, level, ord``; levels may be empty strings, which no level listing
    shows.
    """

    system: str
    versions: tuple[str, ...]
    pull: Callable[[str], DataFrame]
    latest: str
    source: str
    source_url: str | None = None

    def status(self, version: str) -> str:
        return "current" if version == self.latest else "archived"

    def edition(self, version: str) -> DataFrame:
        rows = self.pull(version).withColumn("system", F.lit(self.system)).withColumn("version", F.lit(version))
        return _canonical(parent_by_zero_suffix(rows), self, version, F.col(ORD))

    def list_levels(self, version: str) -> list[str]:
        rows = self.pull(version).where(F.length("level") > 0).select("level").distinct().collect()
        return sorted(r["level"] for r in rows)


def _canonical(rows: DataFrame, adapter, version: str, order: Column) -> DataFrame:
    return conform(rows, order, status=adapter.status(version), source=adapter.source, source_url=adapter.source_url)
