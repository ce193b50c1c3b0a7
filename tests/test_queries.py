"""Every code-list query against DuckDB on the smallest tables; streaming; plans without Python."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from codeatlas import queries

ROOT = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_duckdb(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    cur = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want
    if name != "datasource_level":  # the source itself is Python
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_debounce_as_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from codeatlas.streaming.debounce import debounce, debounce_stream

    schema = "event_id long, user_id long, ts timestamp, value string"
    rows = [(1, 1, "2024-01-01 00:00:00", "a"), (2, 1, "2024-01-01 01:00:00", "ab"), (3, 1, "2024-01-02 00:00:00", "abc"), (4, 2, "2024-01-01 05:00:00", "x"), (5, 3, "2024-02-01 00:00:00", "late")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["event_id"] for r in debounce(df).collect()} == {2, 3, 4, 5}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = debounce_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "value")
    q = out.writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["value"] for r in spark.table("debounced").collect()} == {"ab", "abc", "x"}  # the last one's session has not ended


def test_entry_point_works_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "codeatlas"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "codeatlas").mkdir()
    for p in (ROOT / "codeatlas").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "codeatlas" / p.name)
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_ranked' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry_point_works_without_a_package_of_the_training_data_part():
    code = "import sys; sys.modules['ahocorasick'] = sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'search_ranked' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-W", "ignore", "-c", code], cwd=ROOT, check=True)
