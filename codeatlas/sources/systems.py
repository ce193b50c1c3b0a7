"""Seven public systems: what is fixed about each, and the adapters that serve their editions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import System
from ..plans.service import StoredSource
from .adapters import LevelSource, ReleaseSource
from .artifact import ArtifactMissing
from .store import Store, StoreSource

#: Issuing authority, license, and what a catalog shows of each system.
AUTHORITY = "Philippine Statistics Authority"
LICENSE = "CC BY 4.0 unless otherwise stated by PSA"
URL = "https://psa.gov.ph/classification/"
SYSTEMS = (
    System("psgc", "Philippine Standard Geographic Code", "PSGC", "geographic", "adapter_psgc", True, AUTHORITY, URL + "psgc"),
    System("psic", "Philippine Standard Industrial Classification", "PSIC", "economic", "adapter_phscs", True, AUTHORITY, URL + "psic"),
    System("psoc", "Philippine Standard Occupational Classification", "PSOC", "economic", "adapter_phscs", False, AUTHORITY, URL + "psoc"),
    System("psced", "Philippine Standard Classification of Education", "PSCED", "economic", "adapter_phscs", False, AUTHORITY, URL + "psced"),
    System("pcoicop", "Philippine Classification of Individual Consumption According to Purpose", "PCOICOP", "economic", "adapter_phscs", True, AUTHORITY, URL + "pcoicop"),
    System("pcpc", "Philippine Central Product Classification", "PCPC", "economic", "adapter_phscs", False, AUTHORITY, URL + "pcpc"),
    System("psccs", "Philippine Standard Commodity Classification System", "PSCCS", "economic", "adapter_phscs", False, AUTHORITY, URL + "psccs"),
)
#: Editions of the systems read level by level, with their status; levels from the top.
EDITIONS = {
    "psic": {"2019": "archived"}, "psoc": {"2012": "current"}, "psced": {"2017": "current"}, "pcoicop": {"2020": "current", "2009": "archived"},
    "pcpc": {"2002": "current"}, "psccs": {"2018": "current"},
}
LEVELS = {
    "psic": ("section", "division", "group", "class", "sub-class"),
    "psoc": ("major", "sub-major", "minor", "unit"),
    "psced": ("levels", "broadfield", "narrowfield", "detailedfield"),
    "pcoicop": ("divisions", "groups", "class", "sub-class", "item", "subitem"),
    "pcpc": ("sections", "divisions", "groups", "classes", "sub-classes", "item"),
    "psccs": ("section", "divisions", "groups", "classes", "sub-classes"),
}
#: What the source calls the levels of one system, its stored edition, the releases of another.
LEVEL_ARGS = {"psic": {"section": "sections", "division": "divisions", "group": "groups", "class": "classes", "sub-class": "sub-classes"}}
STORED = ("psic", "2026")
RELEASES = ("Q1_2023", "Q2_2026")


def adapters(
    spark: SparkSession, pull_release: Callable[[str], DataFrame], pull_level: Callable[[str, str, str], DataFrame] | None = None, stored_path: str | None = None,
    metadata_path: str | None = None, store: Store | None = None,
) -> Mapping[str, list]:
    """By system its adapters.  ``pull_release(version)`` and ``pull_level(system, version, level_arg)`` read the raw lists.

    The stored edition comes from a ``store``, or from the files of ``stored_path``.
    """

    def missing(system: str, version: str, level: str) -> DataFrame:
        raise ArtifactMissing(f"The lists of '{system}' are not here.")

    pull = pull_level or missing
    out: dict[str, list] = {"psgc": [ReleaseSource("psgc", RELEASES, pull_release, RELEASES[-1], AUTHORITY, URL + "psgc")]}
    for system, editions in EDITIONS.items():
        read = lambda version, level, system=system: pull(system, version, level)
        out[system] = [LevelSource(system, tuple(editions), LEVELS[system], read, editions.__getitem__, AUTHORITY, URL + system, LEVEL_ARGS.get(system, {}))]
    if store is not None:
        out[STORED[0]].append(StoreSource(store, STORED[0], AUTHORITY, URL + STORED[0]))
    elif stored_path is not None:
        system, version = STORED
        out[system].append(StoredSource(spark, system, version, stored_path, LEVELS[system], metadata_path, source=AUTHORITY, source_url=URL + system))
    return out
