import pytest
from pyspark.sql import functions as F

from codeatlas.plans import schema

GOOD = {"system": "s", "version": "1", "level": "l", "label": "x", "status": "current", "source": "o"}


def test_build_repeats_scalars(spark):
    df = schema.build(spark, ["01", "02"], **GOOD)
    assert df.columns == [*schema.COLUMNS, "ord"]
    assert [(r["code"], r["system"], r["description"], r["ord"]) for r in df.orderBy("ord").collect()] == [("01", "s", None, 0), ("02", "s", None, 1)]


def test_build_refuses_other_lengths(spark):
    with pytest.raises(schema.SchemaError, match="Column 'label' has length 3, expected 1 or 2"):
        schema.build(spark, ["1", "2"], **(GOOD | {"label": ["a", "b", "c"]}))


def test_validate_in_order(spark):
    df = schema.build(spark, ["1"], **GOOD)
    with pytest.raises(schema.SchemaError, match="missing required column"):
        schema.validate(df.drop("label"))
    with pytest.raises(schema.SchemaError, match="must be character: code"):
        schema.validate(df.withColumn("code", F.lit(1)))
    with pytest.raises(schema.SchemaError, match="'label' must not contain NA"):
        schema.validate(df.withColumn("label", F.lit(None).cast("string")).withColumn("status", F.lit("draft")))
    with pytest.raises(schema.SchemaError, match="got: draft"):
        schema.validate(df.withColumn("status", F.lit("draft")))
    schema.validate(df.withColumn("extra", F.lit(1)))


def test_conform_casts_and_fills(spark):
    out = schema.conform(spark.createDataFrame([(1, "x")], "code int, label string"), F.lit(5), system="s", version="1", level="l", status="current", source="o")
    assert tuple(out.first()) == ("s", "1", "l", "1", "x", None, None, "current", "o", None, 5)
    with pytest.raises(schema.SchemaError, match="level"):
        schema.conform(spark.createDataFrame([("1",)], "code string"), system="s", version="1")


def test_label_repair(spark):
    from codeatlas.functions.labels import fill_missing_label

    rows = [("1", None, "TOBACCO This group"), ("2", None, "no caps"), ("3", None, None), ("4", "", "TOBACCO This"), ("5", "kept", "X Yz"), ("6", None, "WINE, BEER-ALE 2 These are")]
    df = spark.createDataFrame(rows, "code string, label string, description string")
    got = {r[0]: r[1] for r in df.select("code", fill_missing_label(F.col("label"), F.col("description"), F.col("code"))).collect()}
    assert got == {"1": "TOBACCO", "2": "2", "3": "3", "4": "", "5": "kept", "6": "WINE, BEER-ALE 2"}
