"""Sources that are read level by level as a data source of Spark: ``spark.read.format(name)``.

A partition is one level of one edition of one system.  Filters on ``system``, ``version`` and ``level`` are taken over by the source before anything is read, so
only the levels asked for are pulled, each by a task.  What a source's pull gives is passed on in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Rows passed on at once.
BATCH = 10_000
#: Reading a source, its filters are pushed only where the session allows it.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "system string, version string, level string, code string, label string, description string, ord long"
_KEYS = ("system", "version", "level")


@dataclass(frozen=True)
class Level(InputPartition):
    """One level of one edition; ``place`` is that of the level from the top."""

    system: str
    version: str
    level: str
    place: int


#: Of a system, version and level: ``code, label, description`` in the source's order.
Pull = Callable[[str, str, str], Iterable[tuple[str, str | None, str | None]]]


def read_level(path: str) -> Iterator[tuple[str, str | None, str | None]]:
    """A pull from Parquet files of ``value, label`` and perhaps ``description``, in order of their names; a batch at a time, in a task."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name[0] not in "._")
    for f in files:
        found = ds.dataset(f, filesystem=store, format="parquet")
        columns = [c for c in ("value", "label", "description") if c in found.schema.names]
        for b in found.to_batches(columns=columns):
            for r in b.to_pylist():
                yield r["value"], r["label"], r.get("description")


def register(spark: SparkSession, name: str, levels: Sequence[tuple[str, str, Sequence[str]]], pull: Pull) -> None:
    """Makes ``spark.read.format(name)`` read ``levels`` (system, version, its levels from the top) by ``pull``.

    ``pull`` runs in the tasks; it must be one that they can import or that can be sent.
    """
    all_levels = [Level(system, version, level, i) for system, version, known in levels for i, level in enumerate(known)]

    class Reader(DataSourceReader):
        def __init__(self) -> None:
            self.kept = all_levels

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            for f in filters:
                if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in _KEYS:
                    self.kept = [x for x in self.kept if getattr(x, f.attribute[0]) == f.value]
                elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in _KEYS:
                    self.kept = [x for x in self.kept if getattr(x, f.attribute[0]) in f.value]
                else:
                    yield f

        def partitions(self) -> Sequence[InputPartition]:
            # a source without partitions would be read as one of its own
            return self.kept or [Level("", "", "", -1)]

        def read(self, partition: Level) -> Iterator[pa.RecordBatch]:
            if partition.place < 0:
                return
            held: list[tuple] = []
            for i, (code, label, description) in enumerate(pull(partition.system, partition.version, partition.level)):
                held.append((partition.system, partition.version, partition.level, code, label, description, (partition.place << 40) + i))
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * 6, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*_KEYS, "code", "label", "description", "ord"])

    class CodeListSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(CodeListSource)
