"""The published code lists: editions that appear whole or not at all.

An edition is written aside, moved to a folder of its own, and becomes visible when the next manifest names that folder.
Readers take the manifest with the highest number that is complete, so they see the editions of before a build or of
after it; a build that fails or dies leaves the manifest as it was.  Two builds at a time both succeed: the second one finds the
number taken and adds its edition to the newer manifest.

Counts, nulls, statuses and a digest of the rows are observed in the write itself: one job.  Rows lie in partitions by system and version, so a join
with the catalog reads the partitions that it selects and no others.

    top/manifests/000000000007.json    a line an edition, then a line with the digest of the lines before
    top/data/system=s/version=v/build=b/*.parquet
    top/index/b                        the search index of that build, if there is one
    top/staging/b                      a build on its way, or one that died
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.search import entry, search
from ..operators.search_index import BLOCK_BYTES, FILE_BYTES, SearchIndex
from ..operators.search_index import build as build_index
from ..operators.sheet import SheetError
from ..plans.schema import COLUMNS, ORD, STORED, SchemaError, check_columns, check_rules, observed_rules
from .artifact import ArtifactMissing
from .files import Files

#: What a manifest says of an edition; ``counts`` by level in the levels' order, ``metadata`` as JSON.
ENTRY = (
    "system string, version string, position int, rank int, build string, status string, rows long, digest string, levels array<string>, counts array<bigint>, files array<struct<name:string,bytes:bigint>>, metadata string"
)
#: Tries to add an edition while others publish, too.
TRIES = 100


class Store:
    """Code lists below a path that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    # manifests

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def _complete(self, number: int) -> list[dict] | None:
        """The editions of a manifest, or None if it was not written to its end."""
        *lines, last = self.files.read(self._manifest(number)).split("\n")
        try:
            whole = json.loads(last).get("sha256") == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        except (ValueError, AttributeError):
            return None
        return [json.loads(x) for x in lines] if whole else None

    def _latest(self) -> tuple[int, list[dict]]:
        for number in reversed(self._numbers()):
            found = self._complete(number)
            if found is not None:
                return number, found
        return 0, []

    def entries(self) -> list[dict]:
        """What is published, in the order in which editions of a system were first published."""
        return self._latest()[1]

    def _change(self, change) -> None:
        """The next manifest: the latest one's editions after ``change``; again if another build was faster."""
        for _ in range(TRIES):
            lines = [json.dumps(x, ensure_ascii=False) for x in _ranked(change(self.entries()))]
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            if self.files.create(self._manifest(max(self._numbers(), default=0) + 1), "\n".join([*lines, json.dumps({"sha256": digest})])):
                return
        raise RuntimeError(f"'{self.path}' changes too fast to publish")

    # publishing

    def publish(
        self, df: DataFrame, levels: Sequence[str], metadata: Mapping | None = None, stated: Mapping[str, int] | None = None, soft: Sequence[str] = (),
        codes: tuple[str, Sequence[str], Sequence[str]] | None = None,
    ) -> dict:
        """One edition in canonical columns and its order key, in place of the one of that name; what the manifest says of it.

        ``stated`` are counts that must be met, but for the levels in ``soft``, whose differences are warnings in the metadata;
        ``codes`` is a label, levels and the codes that entries with that label there must have.  Raises, with nothing published, on the first broken rule.
        """
        check_columns(df)
        build = uuid.uuid4().hex
        staging = f"{self.path}/staging/{build}"
        try:
            seen = self._written(df, staging, levels, codes)
            self._check(seen, levels)
            warnings = _met(dict(zip(levels, seen["counts"], strict=True)), stated or {}, soft)
            _have(seen.get("found"), codes)
            found = {
                "system": seen["system"], "version": seen["version"], "build": build, "status": seen["status"], "rows": seen["rows"], "digest": seen["digest"],
                "levels": list(levels), "counts": seen["counts"], "metadata": json.dumps({**(metadata or {}), **({"warnings": warnings} if warnings else {})}, ensure_ascii=False),
            }
            source = f"{staging}/{self._only(staging)}"
            source = f"{source}/{self._only(source)}"
            target = f"{self.path}/data/{source.removeprefix(staging + '/')}/build={build}"
            self.files.move(source, target)
            try:
                found["files"] = [{"name": n, "bytes": b} for n, b in sorted(self.files.sizes(target).items())]
                found["folder"] = target.removeprefix(f"{self.path}/data/")
                self._change(lambda entries: _placed(entries, found))
            except BaseException:
                self.files.delete(target)
                raise
            return found
        finally:
            self.files.delete(staging)

    def _only(self, folder: str) -> str:
        (name,) = (n for n in self.files.names(folder) if "=" in n)
        return name

    def _written(self, df: DataFrame, path: str, levels: Sequence[str], codes) -> dict:
        """Writes the rows and returns what was observed meanwhile."""
        watched = [
            F.count(F.lit(1)).alias("rows"), *observed_rules(),
            F.min("system").alias("system"), F.max("system").alias("system_to"), F.min("version").alias("version"), F.max("version").alias("version_to"), F.max("status").alias("status_to"), F.min("status").alias("status"),
            F.bit_xor(F.xxhash64(*COLUMNS, ORD)).alias("xor"), F.sum(F.xxhash64(*COLUMNS, ORD).cast("decimal(20,0)")).alias("sum"), *[F.count_if(F.col("level") == lv).alias(f"n{i}") for i, lv in enumerate(levels)],
        ]
        if codes is not None:
            label, where, _ = codes
            watched.append(F.collect_set(F.when((F.col("label") == label) & F.col("level").isin(*where) & F.col("code").isin(*codes[2]), F.col("code"))).alias("found"))
        seen = Observation()
        df.select(*COLUMNS, ORD).observe(seen, *watched).write.partitionBy("system", "version").parquet(path)
        got = seen.get
        return {**got, "counts": [got[f"n{i}"] for i in range(len(levels))], "digest": f"{got['rows']}:{got['xor']}:{got['sum']}"}

    def _check(self, seen: dict, levels: Sequence[str]) -> None:
        if not seen["rows"]:
            raise SchemaError("An edition has rows")
        check_rules(seen)
        for c in ("system", "version", "status"):
            if seen[c] != seen[f"{c}_to"]:
                raise SchemaError(f"An edition has one {c}, got: {seen[c]}, {seen[f'{c}_to']}")
        if sum(seen["counts"]) != seen["rows"]:
            raise SchemaError(f"{seen['rows'] - sum(seen['counts'])} row(s) are in other levels than: {', '.join(levels)}")

    def withdraw(self, system: str, version: str) -> None:
        """Takes an edition out of the manifest; its files stay for those who read it, until ``vacuum``."""
        self._change(lambda entries: [e for e in entries if (e["system"], e["version"]) != (system, version)])

    def vacuum(self) -> list[str]:
        """Deletes what no manifest's latest state names: earlier builds and builds that died.  Not while others read or build."""
        entries = self.entries()
        live, builds = {e["folder"] for e in entries}, {e["build"] for e in entries}
        gone = [f"staging/{b}" for b in self.files.names(f"{self.path}/staging")] + [f"index/{b}" for b in self.files.names(f"{self.path}/index") if b not in builds]
        top = f"{self.path}/data"
        for s in self.files.names(top):
            for v in self.files.names(f"{top}/{s}"):
                gone += [f"data/{s}/{v}/{b}" for b in self.files.names(f"{top}/{s}/{v}") if f"{s}/{v}/{b}" not in live]
        for g in gone:
            self.files.delete(f"{self.path}/{g}")
        return gone

    # reading

    def catalog(self) -> DataFrame:
        """A row an edition, as the manifest has it; Spark reads that file."""
        number, entries = self._latest()
        if not entries:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(self._manifest(number)).where("system is not null")

    def read(self) -> DataFrame:
        """All published rows: canonical columns and the order key; filters on system and version prune partitions."""
        return self._builds().select(*COLUMNS, ORD)

    def _builds(self) -> DataFrame:
        entries = self.entries()
        if not entries:
            raise ArtifactMissing(f"Code lists not found at '{self.path}'. Build them first.")
        data = f"{self.path}/data"
        schema = T.StructType([*STORED.fields, T.StructField("build", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", data).parquet(*[f"{data}/{e['folder']}" for e in entries])

    def selected(self, editions: DataFrame) -> DataFrame:
        """The rows of ``editions`` (filtered rows of the catalog): one scan of the partitions that the join selects.

        The key is the build, a partition of its own for each edition; system and version, pruned one by one, would let pairs through that nobody asked for.
        """
        return self._builds().join(F.broadcast(editions.select("build")), "build").select(*COLUMNS, ORD)

    def current(self) -> DataFrame:
        """The rows of every system's current edition: the first with that status, else the first."""
        return self.selected(current_editions(self.catalog()))

    def edition(self, system: str, version: str) -> DataFrame:
        return self.read().where((F.col("system") == system) & (F.col("version") == version))

    # indexes

    def build_index(self, system: str, version: str, file_bytes: int = FILE_BYTES, block_bytes: int = BLOCK_BYTES) -> SearchIndex:
        """The search index of a published edition, built aside and moved in place whole; it goes with the edition's build."""
        place = f"{self.path}/index/{self.entry(system, version)['build']}"
        aside = f"{self.path}/staging/index-{uuid.uuid4().hex}"
        try:
            build_index(self.edition(system, version), aside, file_bytes, block_bytes)
            self.files.move(aside, place)
        finally:
            self.files.delete(aside)
        return SearchIndex(self.spark, place)

    def index(self, system: str, version: str) -> SearchIndex | None:
        """The index of the edition as it is published now, if it has been built."""
        place = f"{self.path}/index/{self.entry(system, version)['build']}"
        return SearchIndex(self.spark, place) if self.files.exists(place) else None

    def entry(self, system: str, version: str) -> dict:
        for e in self.entries():
            if (e["system"], e["version"]) == (system, version):
                return e
        raise ArtifactMissing(f"'{system}' '{version}' not found at '{self.path}'. Build it first.")


def current_editions(catalog: DataFrame) -> DataFrame:
    """A catalog's current editions, by a filter on the small side: a join prunes the other side's partitions."""
    return catalog.where("rank = 1")


def _ranked(entries: list[dict]) -> list[dict]:
    """With ``rank`` in each system: editions with the status current come first, each in their order."""
    out = []
    for e in entries:
        own = sorted((x for x in entries if x["system"] == e["system"]), key=lambda x: (x["status"] != "current", x["position"]))
        out.append({**e, "rank": 1 + own.index(e)})
    return out


def _placed(entries: list[dict], found: dict) -> list[dict]:
    """``entries`` with ``found`` in the place of the edition of that name, or after the system's others."""
    out = [dict(e) for e in entries]
    for i, e in enumerate(out):
        if (e["system"], e["version"]) == (found["system"], found["version"]):
            out[i] = {**found, "position": e["position"]}
            return out
    return [*out, {**found, "position": 1 + max((e["position"] for e in out if e["system"] == found["system"]), default=0)}]


def _met(counts: Mapping[str, int], stated: Mapping[str, int], soft: Sequence[str]) -> list[str]:
    warnings = []
    for level in sorted(stated):
        if counts.get(level, 0) != stated[level]:
            text = f"Parsed {level} count ({counts.get(level, 0)}) does not match the stated count ({stated[level]})"
            if level not in soft:
                raise SheetError(f"{text} and this is not a documented exception. Aborting build.")
            warnings.append(text)
    return warnings


def _have(found: Sequence[str] | None, codes) -> None:
    if codes is not None and (missing := [c for c in codes[2] if c not in found]):
        raise SheetError(f"Sanity check failed: '{codes[0]}' has no code(s) {', '.join(missing)}")


class StoreSource:
    """A system's editions as a store has them: an adapter of the service and the catalog."""

    def __init__(self, store: Store, system: str, source: str = "stored", source_url: str | None = None):
        self.store, self.system, self.source, self.source_url = store, system, source, source_url

    @property
    def versions(self) -> tuple[str, ...]:
        return tuple(e["version"] for e in self.store.entries() if e["system"] == self.system)

    def status(self, version: str) -> str:
        return self.store.entry(self.system, version)["status"]

    def list_levels(self, version: str) -> list[str]:
        return list(self.store.entry(self.system, version)["levels"])

    def edition(self, version: str) -> DataFrame:
        return self.store.edition(self.system, version)

    def get(self, version: str, level: str | None = None) -> DataFrame:
        """All levels, or one; a level that isn't there is an empty result."""
        df = self.edition(version)
        return df if level is None else df.where(df.level == level)

    def search(self, version: str, query: str | None, level: str | None, limit: int) -> DataFrame:
        """By the edition's index where there is one, else by a scan."""
        index = self.store.index(self.system, version)
        return search(self.edition(version), query, level, limit) if index is None else index.search(query, level, limit)

    def entry(self, version: str, code: str) -> DataFrame:
        index = self.store.index(self.system, version)
        return entry(self.edition(version), code) if index is None else index.entry(code)

    def metadata(self, version: str) -> dict:
        """What was published beside the edition, and what was observed: rows, counts by level, digest."""
        e = self.store.entry(self.system, version)
        observed = {"parsed_counts": dict(zip(e["levels"], e["counts"], strict=True)), "rows": e["rows"], "digest": e["digest"]}
        return {"system": self.system, "version": version, "display_version": version, "status": e["status"], "source": self.source, "source_url": self.source_url} | observed | json.loads(e["metadata"])
