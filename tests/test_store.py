"""Publishing editions: whole or not at all, one job, partitions pruned by the catalog."""

import os
import signal
import subprocess
import sys
import textwrap
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeatlas.operators.sheet import SheetError
from codeatlas.plans.schema import COLUMNS, ORD, SchemaError, build
from codeatlas.plans.service import CodeLists, Unsupported
from codeatlas.sources.artifact import ArtifactMissing, read_editions, write_editions
from codeatlas.sources.store import Store, StoreSource, current_editions

ROOT = Path(__file__).parent.parent


def edition(spark, system="s", version="2020", n=4, status="current", label="x"):
    return build(spark, [f"{i:02d}" for i in range(n)], system=system, version=version, level=["top" if i < 2 else "leaf" for i in range(n)], label=label, status=status, source="y")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/lists")


def codes(df):
    return sorted((r["system"], r["version"], r["code"]) for r in df.select("system", "version", "code").collect())


def test_editions_appear_whole_and_keep_their_place(spark, store):
    with pytest.raises(ArtifactMissing):
        store.read()
    assert store.catalog().collect() == [] and store.entries() == []
    store.publish(edition(spark, version="2020", status="archived"), ["top", "leaf"], {"display_version": "Twenty"})
    store.publish(edition(spark, version="007", n=3), ["top", "leaf"])
    store.publish(edition(spark, system="t", version="Q1 2023/a=b"), ["top", "leaf"])
    found = store.publish(edition(spark, version="2020", n=2, status="archived"), ["top", "leaf"], {"display_version": "Second"})
    assert found["rows"] == 2 and found["counts"] == [2, 0] and len(found["files"]) >= 1
    assert [(e["system"], e["version"], e["position"]) for e in store.entries()] == [("s", "2020", 1), ("s", "007", 2), ("t", "Q1 2023/a=b", 1)]
    assert codes(store.edition("s", "2020")) == [("s", "2020", "00"), ("s", "2020", "01")]
    assert len(codes(store.edition("s", "007"))) == 3 and len(codes(store.edition("t", "Q1 2023/a=b"))) == 4 and store.read().columns == [*COLUMNS, ORD]
    assert [(r["version"], r["counts"]) for r in store.catalog().orderBy("system", "position").collect()] == [("2020", [2, 0]), ("007", [2, 1]), ("Q1 2023/a=b", [2, 2])]
    # the earlier build's files stay for those who read them, until they are swept
    gone = store.vacuum()
    assert len(gone) == 1 and len(codes(store.read())) == 9
    store.withdraw("t", "Q1 2023/a=b")
    assert len(codes(store.read())) == 5


def test_equal_rows_have_equal_digests(spark, store):
    a = store.publish(edition(spark), ["top", "leaf"])
    b = store.publish(edition(spark).repartition(3), ["top", "leaf"])
    c = store.publish(edition(spark, label="z"), ["top", "leaf"])
    assert a["digest"] == b["digest"] != c["digest"]


@pytest.mark.parametrize(
    ("broken", "error", "text"),
    [
        (lambda df: df.drop("label"), SchemaError, "missing required column"), (lambda df: df.withColumn("code", F.lit(1)), SchemaError, "must be character: code"),
        (lambda df: df.withColumn("label", F.when(F.col("code") != "01", "x")), SchemaError, "'label' must not contain NA"),
        (lambda df: df.withColumn("status", F.when(F.col("code") != "01", "draft").otherwise("current")), SchemaError, "got: draft"), (lambda df: df.limit(0), SchemaError, "has rows"),
        (lambda df: df.withColumn("version", F.col("code")), SchemaError, "one version"), (lambda df: df.withColumn("level", F.lit("odd")), SchemaError, r"4 row\(s\) are in other levels"),
        (lambda df: df.withColumn("label", F.when(F.col("code") == "03", F.raise_error(F.lit("half way"))).otherwise(F.col("label"))), Exception, "half way"),
    ],
)
def test_a_failed_build_leaves_no_trace(spark, store, broken, error, text):
    store.publish(edition(spark, n=3), ["top", "leaf"])
    before, listed = codes(store.read()), sorted(p for p in _paths(store))
    with pytest.raises(error, match=text):
        store.publish(broken(edition(spark)), ["top", "leaf"])
    assert codes(store.read()) == before and sorted(_paths(store)) == listed


def _paths(store):
    top = store.path.removeprefix("file://")
    return [os.path.join(d, f) for d, _, names in os.walk(top) for f in names]


def test_stated_counts_and_sanity_codes(spark, store):
    with pytest.raises(SheetError, match=r"Parsed leaf count \(2\) does not match the stated count \(3\) and this is not a documented exception"):
        store.publish(edition(spark), ["top", "leaf"], stated={"top": 2, "leaf": 3})
    with pytest.raises(SheetError, match="'x' has no code.s. 77"):
        store.publish(edition(spark), ["top", "leaf"], codes=("x", ["leaf"], ["02", "77"]))
    assert store.entries() == []
    store.publish(edition(spark), ["top", "leaf"], {"sha256": "ab"}, stated={"top": 2, "leaf": 3}, soft=["leaf"], codes=("x", ["leaf", "top"], ["02", "00"]))
    stated = StoreSource(store, "s").metadata("2020")
    assert stated["parsed_counts"] == {"top": 2, "leaf": 2} and stated["sha256"] == "ab" and stated["warnings"] == ["Parsed leaf count (2) does not match the stated count (3)"]


def test_publishing_is_one_job(spark, store):
    tracker, df = spark.sparkContext.statusTracker(), edition(spark)
    spark.sparkContext.setJobGroup("publish", "one edition")
    try:
        store.publish(df, ["top", "leaf"], stated={"top": 2}, codes=("x", ["top"], ["00"]))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("publish")) == 1


def test_a_build_killed_half_way(spark, store):
    """The process dies while it writes: readers see the edition of before, and a sweep removes what is left."""
    store.publish(edition(spark, n=3), ["top", "leaf"])
    code = f"""
        import sys; sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession, functions as F
        from codeatlas.plans.schema import COLUMNS, ORD
        from codeatlas.sources.store import Store
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        slow = F.udf(lambda i: __import__("time").sleep(0.5 if i % 4 else 0) or f"{{i:02d}}", "string")
        rows = spark.range(0, 400, 1, 8)
        df = rows.select(*[F.lit("s" if c == "system" else "2020" if c == "version" else "top" if c == "level" else "current" if c == "status" else "x").alias(c) for c in COLUMNS if c != "code"], slow("id").alias("code"), F.col("id").alias(ORD))
        Store(spark, {store.path!r}).publish(df, ["top"])
    """
    p = subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    staging = Path(store.path.removeprefix("file://")) / "staging"
    try:
        until = time.time() + 90
        while time.time() < until and not any(f.name.startswith("part-") for f in staging.rglob("*")):
            time.sleep(0.2)
        assert any(f.name.startswith("part-") for f in staging.rglob("*"))
    finally:
        os.killpg(p.pid, signal.SIGKILL)
        p.wait()
    assert len(codes(store.read())) == 3 and [e["rows"] for e in store.entries()] == [3]
    assert [g.split("/")[0] for g in store.vacuum()] == ["staging"] and len(codes(store.read())) == 3
    store.publish(edition(spark, n=4), ["top", "leaf"])
    assert len(codes(store.read())) == 4


def test_a_manifest_cut_short_is_not_read(spark, store):
    store.publish(edition(spark), ["top", "leaf"])
    path = store._manifest(1).removeprefix("file://")
    Path(store._manifest(2).removeprefix("file://")).write_text(Path(path).read_text()[:-20])
    assert [e["version"] for e in store.entries()] == ["2020"]
    store.publish(edition(spark, version="2021"), ["top", "leaf"])
    assert store._numbers() == [1, 2, 3] and [e["version"] for e in store.entries()] == ["2020", "2021"]


def test_builds_at_a_time_all_appear(spark, store):
    errors = []

    def publish(i):
        try:
            store.publish(edition(spark, version=str(i)), ["top", "leaf"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=publish, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(e["version"] for e in store.entries()) == ["0", "1", "2", "3"] and len(codes(store.read())) == 16


def test_the_catalog_prunes_partitions(spark, store):
    for system in "stu":
        for version, status in (("1", "archived"), ("2", "current" if system != "u" else "archived"), ("3", "archived")):
            store.publish(edition(spark, system, version, status=status), ["top", "leaf"])
    assert sorted((r["system"], r["version"]) for r in current_editions(store.catalog()).collect()) == [("s", "2"), ("t", "2"), ("u", "1")]
    df = store.current()
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r["system"], r["version"]) for r in df.collect()} == {("s", "2"), ("t", "2"), ("u", "1")}
    assert _scanned_rows(df) == 12 and store.read().count() == 36


def _scanned_rows(df):
    """Rows that the scan of the table read, by its metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan
    counted, waiting = 0, [plan]
    while waiting:
        p = waiting.pop()
        if p.nodeName().startswith("Scan parquet"):
            counted = max(counted, p.metrics().apply("numOutputRows").value())
        children = p.children()
        waiting += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in p.nodeName():
            waiting.append(p.plan())
    return counted


def test_the_service_over_a_store(spark, store):
    store.publish(edition(spark, version="1", status="archived"), ["top", "leaf"])
    store.publish(edition(spark, version="2", n=5), ["top", "leaf"], {"display_version": "Second", "source_url": "u"})
    lists = CodeLists(spark, {"s": [StoreSource(store, "s")]})
    assert lists.versions("s") == ["1", "2"] and lists.current("s") == "2" and lists.levels("s", "2") == ["top", "leaf"]
    assert lists.get("s", "2", "leaf").count() == 3 and lists.get("s", "2", "").count() == 5
    assert [r["code"] for r in lists.search("s", "2", "0", limit=2).collect()] == ["00", "01"]
    assert lists.metadata("s", "2")["display_version"] == "Second" and lists.metadata("s", "2")["rows"] == 5
    with pytest.raises(Unsupported):
        lists.get("s", "2", "planet")


def test_an_edition_is_searched_by_its_index(spark, store):
    store.publish(edition(spark, n=30), ["top", "leaf"])
    lists = CodeLists(spark, {"s": [StoreSource(store, "s")]})
    want = [lists.search("s", "2020", q, lv).collect() for q in ("1", "x", "") for lv in (None, "leaf")]
    assert store.index("s", "2020") is None
    store.build_index("s", "2020", 2000, 200)
    assert [lists.search("s", "2020", q, lv).collect() for q in ("1", "x", "") for lv in (None, "leaf")] == want
    assert [r["code"] for r in lists.entry("s", "2020", "07").collect()] == ["07"]
    with pytest.raises(FileExistsError):
        store.build_index("s", "2020")
    store.publish(edition(spark, n=31), ["top", "leaf"])
    assert store.index("s", "2020") is None and lists.entry("s", "2020", "30").count() == 1
    assert {g.split("/")[0] for g in store.vacuum()} == {"data", "index"}


def test_write_editions_is_one_job_and_replaces_nothing_on_failure(spark, tmp_path):
    path = f"file://{tmp_path}/lists"
    write_editions(edition(spark, version="1").unionByName(edition(spark, version="2")), path)
    with pytest.raises(SchemaError, match="got: draft"):
        write_editions(edition(spark, version="1", n=2).withColumn("status", F.lit("draft")), path)
    assert read_editions(spark, path).count() == 8 and not [n for n in os.listdir(tmp_path / "lists") if n.startswith("_staging")]
    write_editions(edition(spark, version="1", n=2), path)
    assert read_editions(spark, path).count() == 6
