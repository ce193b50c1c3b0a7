"""Row numbers by position, and a sheet from its file to the service."""

import hashlib
import random

import pytest

from codeatlas.operators.sheet import SheetError
from codeatlas.plans.build import SheetPlan, build_edition
from codeatlas.plans.service import CodeLists
from codeatlas.sources.artifact import ArtifactMissing
from codeatlas.sources.lines import numbered_lines, read_numbered_sheet
from codeatlas.sources.store import Store, StoreSource


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield spark
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_line_numbers_are_those_of_one_task(small_splits, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in ("a", "b", "c"):
        lines = ["x" * rng.randrange(60) + str(i) * rng.randrange(2) for i in range(rng.randrange(100, 200))]
        (tmp_path / f"{name}.csv").write_text("".join(f"{x}\n" for x in lines))
        want |= {(name, i): x for i, x in enumerate(lines, 1)}
    df = numbered_lines(small_splits, f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() > 10
    assert {(r["file"].rsplit("/", 1)[1][0], r["line_no"]): r["value"] for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


def test_a_sheet_by_header_and_line(small_splits, tmp_path):
    rows = [["description", "item", "extra", "brand"], ['"a, b"', "01", "", "x"], [], ["c", "", "z", ""], ["é", "02", "", '"q ""r"""']] + [["d", f"{i:03d}", "", ""] for i in range(200)]
    (tmp_path / "s.csv").write_text("".join(",".join(r) + "\n" for r in rows))
    got = [tuple(r) for r in read_numbered_sheet(small_splits, f"file://{tmp_path}/s.csv", ["brand", "item", "description"]).orderBy("row_no").collect()]
    assert got[:3] == [(2, "x", "01", "a, b"), (4, None, None, "c"), (5, 'q "r"', "02", "é")] and got[-1] == (205, None, "199", "d") and len(got) == 203
    with pytest.raises(SheetError, match="missing column.s.: size"):
        read_numbered_sheet(small_splits, f"file://{tmp_path}/s.csv", ["size"])
    with pytest.raises(ArtifactMissing):
        read_numbered_sheet(small_splits, f"file://{tmp_path}/none.csv", ["size"])
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(SheetError, match="no rows"):
        read_numbered_sheet(small_splits, f"file://{tmp_path}/empty.csv", ["size"])


SHEET = """section,division,group,class,subclass,description
A,,,,,Farming
,01,,,,Crops
,,011,,,Cereals
,,,0111,01110,"Rice, wet"
,,,,01119,Rice n.e.c.

,75,750,7500,75000,Animal care
B,,,,,Mining
,02,,,,Coal
"""
PLAN = SheetPlan(
    "ind", "2026", ("section", "division", "group", "class", "subclass"), "office", source_url="http://x", names={"subclass": "sub-class"},
    stated={"section": 2, "division": 3, "group": 3, "class": 2, "sub-class": 3}, soft=("group",),
    codes=("Animal care", ["division", "group", "class", "sub-class"], ["75", "750", "7500", "75000"]), metadata={"display_version": "Revision 5 (2026)", "retrieved_at": "2026-08-23"},
)


def test_a_sheet_becomes_an_edition(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SHEET)
    store = Store(spark, f"file://{tmp_path}/lists")
    found = build_edition(spark, f"file://{tmp_path}/s.csv", store, PLAN, block=2)
    assert found["rows"] == 12 and found["counts"] == [2, 3, 2, 2, 3]
    lists = CodeLists(spark, {"ind": [StoreSource(store, "ind", "office", "http://x")]})
    rows = lists.get("ind", "2026").orderBy("ord").collect()
    assert [(r["level"], r["code"], r["parent_code"]) for r in rows] == [
        ("section", "A", None), ("division", "01", "A"), ("group", "011", "01"), ("class", "0111", "011"), ("sub-class", "01110", "0111"), ("sub-class", "01119", "0111"),
        ("division", "75", "A"), ("group", "750", "75"), ("class", "7500", "750"), ("sub-class", "75000", "7500"), ("section", "B", None), ("division", "02", "B"),
    ]
    stated = lists.metadata("ind", "2026")
    assert stated["sha256"] == hashlib.sha256(SHEET.encode()).hexdigest() and stated["parsed_counts"]["sub-class"] == 3 and stated["display_version"] == "Revision 5 (2026)"
    assert stated["warnings"] == ["Parsed group count (2) does not match the stated count (3)"] and stated["stated_counts"]["group"] == 3
    assert [r["code"] for r in lists.search("ind", "2026", "rice").collect()] == ["0111", "01110", "01119"]


@pytest.mark.parametrize(
    ("edit", "text"),
    [
        (lambda s: s.replace("B,,,,,Mining", "B,,,,,"), "Row 9 has no description"), (lambda s: s.replace("B,,,,,Mining\n", ""), r"Parsed section count \(1\) does not match the stated count \(2\)"),
        (lambda s: s.replace("75000,Animal care", "75001,Animal care"), "'Animal care' has no code.s. 75000"), (lambda s: s.replace("class,", "klass,", 1), "missing column.s.: class"),
        (lambda s: s.split("\n")[0] + "\n", "no rows"),
    ],
)
def test_a_wrong_sheet_publishes_nothing(spark, tmp_path, edit, text):
    (tmp_path / "s.csv").write_text(edit(SHEET))
    store = Store(spark, f"file://{tmp_path}/lists")
    with pytest.raises(SheetError, match=text):
        build_edition(spark, f"file://{tmp_path}/s.csv", store, PLAN)
    assert store.entries() == []
