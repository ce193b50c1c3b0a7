"""The service over code lists: systems, editions, levels, lists, search, lookup and provenance."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators import search as _search
from ..sources.artifact import ArtifactMissing, read_editions, read_metadata
from .schema import COLUMNS, ORD


class Unsupported(ValueError):
    """An unknown system, version or level."""


class StoredSource:
    """One edition served from the stored code lists; levels are in hierarchy order."""

    def __init__(
        self, spark: SparkSession, system: str, version: str, path: str, levels: tuple[str, ...], metadata_path: str | None = None, status: str = "archived",
        source: str = "stored", source_url: str | None = None,
    ):
        self.spark, self.system, self.version, self.path, self.levels, self.metadata_path, self._status = spark, system, version, path, levels, metadata_path, status
        self.source, self.source_url = source, source_url

    @property
    def versions(self) -> tuple[str, ...]:
        """The edition, or nothing while it is not built: a catalog goes on without it."""
        try:
            read_editions(self.spark, self.path)
        except ArtifactMissing:
            return ()
        return (self.version,)

    def status(self, version: str) -> str:
        """As the metadata beside the artifact says of this edition; the one given where there is none."""
        try:
            stated = self.metadata(version)
        except ArtifactMissing:
            return self._status
        return stated.get("status", self._status) if stated.get("version", version) == version else self._status

    def metadata(self, version: str) -> dict:
        if self.metadata_path is None:
            return {}
        return read_metadata(self.spark, self.metadata_path)

    def edition(self, version: str) -> DataFrame:
        df = read_editions(self.spark, self.path)
        return df.where((df.system == self.system) & (df.version == version))

    def list_levels(self, version: str) -> list[str]:
        return list(self.levels)

    def get(self, version: str, level: str | None = None) -> DataFrame:
        """All levels, or one that it has."""
        if level is not None and level not in self.levels:
            raise Unsupported(f"Unsupported {self.system.upper()} level '{level}'. Available levels: {', '.join(self.levels)}")
        df = self.edition(version)
        return df if level is None else df.where(df.level == level)


class CodeLists:
    """Seven calls over a set of adapters, by system; a system may have several adapters for different editions.

    A level of None or the empty string means all levels.
    """

    def __init__(self, spark: SparkSession, adapters: Mapping[str, list], today: datetime.date | None = None, license: str = "see source"):
        self.spark, self.adapters, self.license = spark, {k: list(v) for k, v in adapters.items()}, license
        self.today = today or datetime.date.today()

    def _adapter(self, system: str, version: str):
        self._known(system)
        version = str(version)
        for a in self.adapters[system]:
            if version in a.versions:
                return a
        raise Unsupported(f"Unsupported version '{version}' for system '{system}'. Available versions: {', '.join(self.versions(system))}")

    def _known(self, system: str) -> None:
        if system not in self.adapters:
            raise Unsupported(f"Unsupported classification system '{system}'. Available systems: {', '.join(self.adapters)}")

    def systems(self) -> list[str]:
        return list(self.adapters)

    def versions(self, system: str) -> list[str]:
        self._known(system)
        return list(dict.fromkeys(v for a in self.adapters[system] for v in a.versions))

    def current(self, system: str) -> str | None:
        """The first version with status current, else the first."""
        versions = self.versions(system)
        return next((v for v in versions if self._adapter(system, v).status(v) == "current"), versions[0] if versions else None)

    def levels(self, system: str, version: str) -> list[str]:
        return self._adapter(system, version).list_levels(str(version))

    def _level(self, system: str, version: str, level: str | None) -> None:
        if level is not None and level not in (known := self.levels(system, version)):
            raise Unsupported(f"Unsupported level '{level}' for system '{system}' version '{version}'. Available levels: {', '.join(known)}")

    def get(self, system: str, version: str, level: str | None = None) -> DataFrame:
        """The edition in canonical columns and its order key, all levels or one."""
        adapter = self._adapter(system, version)
        level = level or None
        self._level(system, version, level)
        df = adapter.edition(str(version)).select(*COLUMNS, ORD)
        return df if level is None else df.where(df.level == level)

    def search(self, system: str, version: str, query: str | None, level: str | None = None, limit: int = 100) -> DataFrame:
        level = level or None
        self._level(system, version, level)
        adapter = self._adapter(system, version)
        if hasattr(adapter, "search"):
            return adapter.search(str(version), query, level, limit)
        return _search.search(self.get(system, version), query, level, limit)

    def entry(self, system: str, version: str, code: str) -> DataFrame:
        adapter = self._adapter(system, version)
        if hasattr(adapter, "entry"):
            return adapter.entry(str(version), code)
        return _search.entry(self.get(system, version), code)

    def metadata(self, system: str, version: str) -> dict:
        a, version = self._adapter(system, version), str(version)
        out = {
            "system": system, "version": version, "display_version": version, "status": a.status(version), "source": a.source, "source_url": a.source_url,
            "retrieved_at": self.today.isoformat(), "license": self.license,
        }
        return out | a.metadata(version)

    def cascade(self, system: str, version: str | None = None) -> dict:
        """What dependent selectors show: versions with the current one chosen, levels with all chosen."""
        versions = self.versions(system)
        chosen = version if version in versions else self.current(system)
        return {"versions": versions, "version": chosen, "levels": self.levels(system, chosen) if chosen else [], "level": None}
