import random

import pytest

from codeatlas.operators import sheet

SCHEMA = "row_no long, a string, b string, c string, description string"


def parsed(df, **how):
    return [tuple(r)[-4:] for r in sheet.parse_wide_sheet(df, ["a", "b", "c"], **how).orderBy("ord").collect()]


def test_one_row_with_all_codes(spark):
    df = spark.createDataFrame([(1, "7", "75", "750", "Vets")], SCHEMA)
    assert parsed(df) == [("a", "7", "Vets", None), ("b", "75", "Vets", "7"), ("c", "750", "Vets", "75")]


def test_stale_ancestor_wins_and_row_without_codes(spark):
    rows = [(1, "1", None, None, "x"), (2, None, "11", None, "x"), (3, "2", None, None, "x"), (4, None, None, None, "none"), (5, None, None, "999", "y")]
    assert parsed(spark.createDataFrame(rows, SCHEMA))[-1] == ("c", "999", "y", "11")


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_random_sheet_against_a_loop(spark, block):
    rnd = random.Random(3)
    rows = [(i, *[f"{lv}{i}" if rnd.random() < 0.3 else None for lv in "abc"], f"d{i}") for i in range(1, 200)]
    seen, want = {}, []
    for i, *cells, d in rows:
        for k, code in enumerate(cells):
            if code is not None:
                want.append(("abc"[k], code, d, next((seen[j] for j in range(k - 1, -1, -1) if j in seen), None)))
                seen[k] = code
    assert parsed(spark.createDataFrame(rows, SCHEMA), block=block) == want


def test_sheets_do_not_mix_and_levels_are_renamed(spark):
    df = spark.createDataFrame([("x", 1, "1", None, "one"), ("y", 1, None, "11", "two")], "sheet string, row_no long, a string, b string, description string")
    out = {r["code"]: r for r in sheet.parse_wide_sheet(df, ["a", "b"], sheet_col="sheet", names={"b": "sub-b"}).collect()}
    assert out["11"]["parent_code"] is None and out["11"]["level"] == "sub-b"


def test_checks(spark):
    good = spark.createDataFrame([(1, "1", None, None, "x"), (2, None, "11", None, None)], SCHEMA)
    with pytest.raises(sheet.SheetError, match="Row 2"):
        sheet.check_sheet(good, ["a", "b", "c"])
    with pytest.raises(sheet.SheetError, match="no rows"):
        sheet.check_sheet(good.limit(0), ["a"])
    with pytest.raises(sheet.SheetError, match="missing column"):
        sheet.check_sheet(good, ["z"])


def test_counts_soft_and_hard(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "level string")
    counts = sheet.level_counts(rows, ["a", "b", "c"])
    assert {r["level"]: r["n"] for r in counts.collect()} == {"a": 2, "b": 1, "c": 0}
    stated = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0)], "level string, n long")
    checked = sheet.reconcile(counts, stated)
    assert {r["level"]: r["result"][:4] for r in checked.collect()} == {"a": "PASS", "b": "WARN", "c": "PASS"}
    assert len(sheet.require_counts(checked, soft=["b"])) == 1
    with pytest.raises(sheet.SheetError, match="b count"):
        sheet.require_counts(checked)
