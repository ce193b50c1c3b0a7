"""From a sheet to a published edition: parse, count, check, conform, publish, with its provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sheet import check_sheet, parse_wide_sheet
from ..sources.artifact import file_digests
from ..sources.lines import read_numbered_sheet
from ..sources.store import Store
from .schema import ORD, conform


@dataclass(frozen=True)
class SheetPlan:
    """What is known of a sheet before it is read.

    ``levels`` are its columns from the top, ``names`` what their levels are called where that differs; ``stated`` the counts that its publisher states by
    level, ``soft`` the levels where a difference is documented; ``codes`` a label, levels and the codes that entries with that label there must have.
    """

    system: str
    version: str
    levels: tuple[str, ...]
    source: str
    status: str = "current"
    source_url: str | None = None
    label: str = "description"
    names: Mapping[str, str] = field(default_factory=dict)
    stated: Mapping[str, int] = field(default_factory=dict)
    soft: tuple[str, ...] = ()
    codes: tuple[str, Sequence[str], Sequence[str]] | None = None
    metadata: Mapping = field(default_factory=dict)

    def level_names(self) -> list[str]:
        return [self.names.get(c, c) for c in self.levels]


def parse(spark: SparkSession, path: str, plan: SheetPlan, block: int = 100_000) -> DataFrame:
    """The canonical rows of a sheet, in the order of its lines and of the levels on a line; errors name the line."""
    columns = [*plan.levels, plan.label]
    rows = read_numbered_sheet(spark, path, columns)
    check_sheet(rows, ["row_no", *columns], label_col=plan.label)
    parsed = parse_wide_sheet(rows, plan.levels, label_col=plan.label, names=plan.names, block=block)
    return conform(parsed, F.col(ORD), system=plan.system, version=plan.version, status=plan.status, source=plan.source, source_url=plan.source_url)


def build_edition(spark: SparkSession, path: str, store: Store, plan: SheetPlan, block: int = 100_000) -> dict:
    """Publishes a sheet as an edition; what the store says of it.

    Counts and codes are observed while the rows are written; nothing is published where one is wrong.  The digest of the file and
    the stated counts go into the edition's metadata.
    """
    digests = [r["sha256"] for r in file_digests(spark, path).orderBy("path").collect()]
    provenance = {
        "display_version": plan.version, **plan.metadata, "sha256": digests[0] if len(digests) == 1 else digests, "stated_counts": dict(plan.stated),
        "source": plan.source, "source_url": plan.source_url,
    }
    return store.publish(parse(spark, path, plan, block), plan.level_names(), provenance, plan.stated, plan.soft, plan.codes)
