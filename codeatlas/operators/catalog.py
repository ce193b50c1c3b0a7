"""The catalog of systems, editions and levels.

Versions, their status and levels are asked of the adapters each time; nothing here holds a second copy.  An adapter whose
data is missing or broken takes its own editions out of the catalog, and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.collation import by_language

#: What an adapter raises when its data is missing or broken.
BROKEN = (OSError, ValueError, PySparkException)


@dataclass(frozen=True)
class System:
    """What is fixed about a system."""

    id: str
    display_name: str
    short_name: str
    category: str
    adapter: str
    supports_history: bool
    source: str
    source_url: str


def _tried(call: Callable, otherwise):
    try:
        return call()
    except BROKEN:
        return otherwise


def listed_editions(adapters: Mapping[str, list]) -> list[tuple]:
    """``system, version, ord, status`` in the order of the adapters, counted from 1 in a system."""
    out = []
    for system, serving in adapters.items():
        seen: dict[str, str] = {}
        for a in serving:
            for v, status in _tried(lambda a=a: [(v, a.status(v)) for v in a.versions], []):
                seen.setdefault(v, status)
        out += [(system, v, i, status) for i, (v, status) in enumerate(seen.items(), 1)]
    return out


def listed_levels(adapters: Mapping[str, list]) -> list[tuple]:
    """``system, ord, level``: the levels of all editions in the order they are first seen."""
    out = []
    for system, serving in adapters.items():
        seen: dict[str, None] = {}
        for a in serving:
            seen |= dict.fromkeys(_tried(lambda a=a: [lv for v in a.versions for lv in a.list_levels(v)], []))
        out += [(system, i, lv) for i, lv in enumerate(seen)]
    return out


def editions(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), "system string, version string, ord int, status string")


def levels_of(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), "system string, ord int, level string")


def level_args(spark: SparkSession, adapters: Mapping[str, list]) -> DataFrame:
    """``system, level, level_arg``: what a source that is read by levels calls each."""
    rows = [(system, lv, a.level_args.get(lv, lv)) for system, serving in adapters.items() for a in serving if hasattr(a, "level_args") for lv in a.levels]
    return spark.createDataFrame(rows, "system string, level string, level_arg string")


def version_status(versions: DataFrame, rule: str = "stated", latest: str | None = None) -> DataFrame:
    """``system, version, status``: as stated, or current only for the ``latest`` version."""
    if rule == "stated":
        return versions.select("system", "version", "status")
    return versions.select("system", "version", F.when(F.col("version") == F.lit(latest), "current").otherwise("archived").alias("status"))


def current_version(versions: DataFrame) -> DataFrame:
    """By system the first version with status current, else the first."""
    first_current = F.min_by("version", F.when(F.col("status") == "current", F.col("ord")))
    return versions.groupBy("system").agg(F.coalesce(first_current, F.min_by("version", "ord")).alias("current_version"))


def current_version_latest(versions: DataFrame, latest: DataFrame) -> DataFrame:
    """By system the catalog's latest version if it is listed, else the last listed.

    "Latest" is an attribute of the catalog: edition names don't sort by time.
    """
    joined = versions.join(latest.select("system", "latest"), "system", "left")
    listed = F.max(F.when(F.col("version") == F.col("latest"), F.col("version")))
    return joined.groupBy("system").agg(F.coalesce(listed, F.max_by("version", "ord")).alias("current_version"))


def available_levels(df: DataFrame) -> DataFrame:
    """``system, pos, level``: distinct levels over all editions in the order they are first seen, from 1."""
    seen = df.groupBy("system", "level").agg(F.min("ord").alias("ord"))
    ordered = seen.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("ord", "level"))).alias("a"))
    return ordered.select("system", F.posexplode("a").alias("pos", "x")).select("system", (F.col("pos") + 1).cast("long").alias("pos"), F.col("x.level").alias("level"))


def distinct_levels_sorted(df: DataFrame, collation: str | None = None) -> DataFrame:
    """``system, version, pos, level``: distinct non-empty levels of an edition, sorted by code point or a collation, from 1."""
    if collation is not None:
        names = df.where(F.length("level") > 0).select("system", "version", "level").distinct()
        place = F.row_number().over(W.partitionBy("system", "version").orderBy(*by_language(F.col("level"), collation)))
        return names.select("system", "version", place.cast("long").alias("pos"), "level")
    kept = df.where(F.length("level") > 0).groupBy("system", "version").agg(F.sort_array(F.collect_set("level")).alias("a"))
    return kept.select("system", "version", F.posexplode("a").alias("pos", "level")).withColumn("pos", (F.col("pos") + 1).cast("long"))


def versions_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """``system, pos, version``: versions of ``a`` then those only ``b`` has, each in its order, from 1."""

    def lists(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("system").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "version"))), lambda x: x["version"]).alias(name))

    both = lists(a, "x").join(lists(b, "y"), "system", "full_outer")
    none = F.array().cast("array<string>")
    merged = both.select("system", F.posexplode(F.array_union(F.coalesce("x", none), F.coalesce("y", none))).alias("pos", "version"))
    return merged.withColumn("pos", (F.col("pos") + 1).cast("long"))


def registry(spark: SparkSession, systems: Iterable[System], adapters: Mapping[str, list]) -> DataFrame:
    """One row per system, eleven columns; a system without editions or levels still has its row."""
    versions, levels = editions(spark, listed_editions(adapters)), levels_of(spark, listed_levels(adapters))
    rows = [(s.id, s.display_name, s.short_name, s.category, s.adapter, s.supports_history, s.source, s.source_url) for s in systems]
    fixed = spark.createDataFrame(rows, "id string, display_name string, short_name string, category string, adapter string, supports_history boolean, source string, source_url string")
    listed = versions.groupBy("system").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "version"))), lambda x: x["version"]).alias("available_versions"))
    leveled = levels.groupBy("system").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "level"))), lambda x: x["level"]).alias("available_levels"))
    none = F.array().cast("array<string>")
    out = fixed
    for part in (listed, current_version(versions), leveled):
        out = out.join(part.withColumnRenamed("system", "id"), "id", "left")
    return out.select(
        "id", "display_name", "short_name", "category", "adapter", F.coalesce("available_versions", none).alias("available_versions"), "current_version",
        F.coalesce("available_levels", none).alias("available_levels"), "supports_history", "source", "source_url",
    )


def choices(reg: DataFrame) -> DataFrame:
    """What a selector shows: ``id, label``."""
    return reg.select("id", F.concat_ws(" — ", "short_name", "display_name").alias("label"))


def sources(reg: DataFrame) -> DataFrame:
    return reg.select("short_name", "display_name", "source", "source_url")
