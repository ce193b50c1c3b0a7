"""Debouncing by the clock: the last input comes out with nothing after it, and its state goes."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from codeatlas.streaming.debounce import STATE_STORE, debounce, debounce_by_clock

SCHEMA = "event_id long, user_id long, ts timestamp, value string"


@pytest.fixture
def timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    yield spark
    spark.conf.set(key, before)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts string, value string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_the_last_input_comes_out_by_the_clock(timers, tmp_path):
    spark, gap = timers, datetime.timedelta(seconds=3)
    first = [(1, 1, "2024-01-01 00:00:00", "a"), (2, 1, "2024-01-01 00:00:02", "ab"), (3, 1, "2024-01-01 00:00:09", "abc"), (4, 2, "2024-01-01 05:00:00", "x"), (5, 3, None, "nothing")]
    second = [(6, 1, "2024-01-01 00:00:11", "abcd"), (7, 1, "2024-01-01 00:00:10", "late, within the gap"), (8, 4, "2024-01-01 00:00:00", None)]
    rows_of(spark, first).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = debounce_by_clock(stream, "value", gap)
    q = out.writeStream.format("memory").queryName("clocked").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start()
    try:
        found = lambda: sorted((r["user_id"], str(r["ts"]), r["value"]) for r in spark.table("clocked").collect())
        rows_of(spark, second).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        want = debounce(rows_of(spark, [r for r in first + second if r[2]]), "3 seconds")
        want = sorted((r["user_id"], str(r["ts"]), r["value"]) for r in want.collect())
        until = time.time() + 120
        while time.time() < until and q.isActive and (len(found()) < len(want) or (q.lastProgress and sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))):
            time.sleep(1)
        assert found() == want  # as of a batch, without a later event
        assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == 0
    finally:
        q.stop()
