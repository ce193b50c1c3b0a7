"""A source read level by level: only the levels asked for are pulled."""

import os

import pytest
from pyspark.sql import functions as F

from codeatlas.sources.datasource import BATCH, register

LEVELS = [("a", "1", ["top", "leaf"]), ("a", "2", ["top", "mid", "leaf"]), ("b", "1", ["top"])]


@pytest.fixture
def source(spark, tmp_path):
    log = str(tmp_path)

    def pull(system, version, level):
        open(f"{log}/{system}-{version}-{level}-{os.urandom(4).hex()}", "w").close()
        n = BATCH + 5 if (system, level) == ("b", "top") else 3
        return ((f"{level}{i}", f"{system}{version}" if i else None, None) for i in range(n))

    register(spark, "pulled_lists", LEVELS, pull)

    def pulled():
        found = sorted(n.rsplit("-", 1)[0] for n in os.listdir(log))
        for n in os.listdir(log):
            os.remove(f"{log}/{n}")
        return found

    return spark.read.format("pulled_lists").load(), pulled


def test_everything(source):
    df, pulled = source
    assert df.count() == 15 + BATCH + 5 and pulled() == ["a-1-leaf", "a-1-top", "a-2-leaf", "a-2-mid", "a-2-top", "b-1-top"]
    first = df.where("system = 'a' and version = '2'").orderBy("ord").collect()
    assert [r["code"] for r in first] == ["top0", "top1", "top2", "mid0", "mid1", "mid2", "leaf0", "leaf1", "leaf2"] and first[0]["label"] is None


@pytest.mark.parametrize(
    ("where", "levels", "n"),
    [
        ("level = 'mid'", ["a-2-mid"], 3), ("system = 'a' and level in ('top', 'leaf')", ["a-1-leaf", "a-1-top", "a-2-leaf", "a-2-top"], 12), ("level = 'top' and code = 'top1'", ["a-1-top", "a-2-top", "b-1-top"], 3),
        ("level = 'none'", [], 0), ("version = '1' and system = 'b'", ["b-1-top"], BATCH + 5),
    ],
)
def test_filters_reach_the_pull(source, where, levels, n):
    df, pulled = source
    assert df.where(where).count() == n and pulled() == levels


def test_a_level_filter_by_column(source):
    df, pulled = source
    assert df.where(F.col("level") == "leaf").select("code").distinct().count() == 3 and pulled() == ["a-1-leaf", "a-2-leaf"]
