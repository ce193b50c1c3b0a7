"""The stored index against the scan it replaces: same rows, fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import search_index
from codeatlas.operators.search import entry, search
from codeatlas.plans.schema import ORD, build
from codeatlas.sources import fixtures

WORDS = ["Red", "widget", "RED  widget", "blue", "Größe", "naïve", "0.5%_[x]", "(garden)", "a\tb", "x\U0001f600y", "tea", "a", "ab", "'quoted'"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(7)
    n = 400
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, k)))
    codes = [rng.choice(["K", "k", "0", "é"]) + str(rng.randrange(300)) for _ in range(n)]
    df = build(spark, codes, system="s", version="1", level=[rng.choice(["top", "mid"]) for _ in range(n)], label=[text(4) for _ in range(n)], description=[text(9) if rng.random() < 0.8 else None for _ in range(n)], status="current", source="x")
    path = f"file://{tmp_path_factory.mktemp('edition')}/e"
    df.withColumn(ORD, F.col(ORD) * 7 % 400).orderBy(F.rand(3)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module", params=[(1 << 30, 1 << 20), (9000, 600)])
def index(request, data, tmp_path_factory):
    file_bytes, block_bytes = request.param
    return search_index.build(data, f"file://{tmp_path_factory.mktemp('index')}/i", file_bytes, block_bytes)


QUERIES = [
    "k1", "K10", "0", "é2", "red", "Red widget", "RED \t widget", "wid", "idge", "größe", "ÖSSE", "ïve", "%_[", "(garden)", "a b", "\U0001f600", "x\U0001f600y", "tea", "a", "ab", "'quoted'", "no such thing",
    "red widget blue", "e w", "widget red widget tea", "", " \t", None, "\U0010ffff", "k299",
]


@pytest.mark.parametrize(("level", "limit", "step"), [(None, 1000, 1), ("top", 7, 3), (None, 1, 9), ("nowhere", 5, 15)])
def test_the_rows_of_a_scan(data, index, level, limit, step):
    for q in QUERIES[::step] if index.files()[1:] else QUERIES[:: step * 6]:
        want = [tuple(r) for r in search(data, q, level, limit, ranked=True).orderBy("pos").collect()]
        got = index.search(q, level, limit, ranked=True)
        assert [tuple(r) for r in got.collect()] == want, q
    assert index.search("red").columns == search(data, "red").columns


def test_entries_and_limits(data, index):
    for code in ("K10", "k10", " K10", "0", "é2", "é299", "nothing"):
        assert sorted(map(tuple, index.entry(code).collect())) == sorted(map(tuple, entry(data, code).collect()))
    with pytest.raises(ValueError):
        index.search("red", limit=-1)


@pytest.mark.parametrize("size", [90])
def test_pages_are_those_of_an_offset(data, index, size):
    everything = [tuple(r)[:-1] for r in data.orderBy(ORD).collect()]
    last = None
    for number in range(400 // size + 2):
        want = everything[number * size : (number + 1) * size]
        assert [tuple(r)[:10] for r in index.page(number, size).collect()] == want
        rows = index.next_page(last, size).collect()
        assert [tuple(r)[:10] for r in rows] == want
        last = rows[-1][ORD] if rows else last
    assert [tuple(r)[:10] for r in index.page(399, 1).collect()] == everything[-1:]


def test_an_empty_edition(spark, data, tmp_path):
    empty = search_index.build(data.limit(0), f"file://{tmp_path}/i")
    assert empty.search("red").collect() == empty.search("").collect() == empty.entry("K1").collect() == empty.page(0).collect() == empty.next_page(None).collect() == []


def test_a_rare_query_reads_few_files(spark, tmp_path):
    n = 2000
    codes = [f"{i:05d}" for i in range(n)]
    text = lambda i: f"common words in every text {i % 17} " + ("needle in row" if i == 1234 else "")
    df = build(spark, codes, system="s", version="1", level="l", label=[f"label {i % 5}" for i in range(n)], description=[text(i) for i in range(n)], status="current", source="x")
    index = search_index.build(df, f"file://{tmp_path}/i", file_bytes=8000, block_bytes=1000)
    files = index.files()
    assert len(files) > 20
    found = index.search("needle")
    assert [r["code"] for r in found.collect()] == ["01234"]
    assert len(found.inputFiles()) == 1 and len(index.files(index.candidates("description", "needle"))) == 1
    # trigrams that every block has, but not one after the other
    assert search_index.grams("xt 3 comm", 3) and len(index.files(index.candidates("description", "every text 3"))) > 5 and index.search("text 3 comm").collect() == []
    assert len(index.candidates("description", "text 3 comm")) < len(index.candidates("description", "xt 3")) / 5
    # a common query stops at the first blocks
    read = []
    index.rows, rows = lambda blocks=None: read.append(blocks) or rows(blocks), index.rows
    assert index.search("every text", limit=5).count() == 5
    assert sum(len(b) for b in read[:-1]) <= search_index.FIRST_BLOCKS and len(index.candidates("description", "every text")) > 100
    # a deep page reads the blocks it lies in
    assert len(index.page(130, 15).inputFiles()) <= 2


def test_prefixes_are_pushed_ranges(spark, index):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for table, key in (("codes", "code_norm"), ("labels", "label_norm")):
        text = plan(index._table(table).where(search_index.in_prefix(F.col(key), "red")))
        assert f"GreaterThanOrEqual({key},red)" in text and f"LessThan({key},ree)" in text
    ranged = index.rows([0, 1])
    assert "GreaterThanOrEqual(row," in plan(ranged)
    assert "Python" not in plan(index.search("red"))


@pytest.mark.parametrize(("prefix", "end"), [("a", "b"), ("az", "a{"), ("퟿", ""), ("a\U0010ffff", "b"), ("\U0010ffff", None), ("", None)])
def test_the_end_of_a_prefix(prefix, end):
    assert search_index.after(prefix) == end


def test_a_common_label_lies_in_several_files(spark, tmp_path):
    df = build(spark, [f"{i:04}" for i in range(600)], system="s", version="1", level="a", label="same label", description=None, status="current", source="x")
    made = search_index.build(df, f"file://{tmp_path}/i", 9000, 600)
    held = spark.read.parquet(f"{made.path}/labels").select(F.col("_metadata.file_name").alias("f")).distinct().count()
    assert len(made.files()) > 3 and held > 3
    assert [r["code"] for r in made.search("same label", None, 600).collect()] == [f"{i:04}" for i in range(600)]


def test_derived_indexes_have_files_of_many_rows(spark, small):
    """A file is a task of each table, whose result goes to the driver."""
    assert len(fixtures.indexed(spark, small, "docs").files()) == 1


def test_grams_of_any_characters(spark, tmp_path):
    texts = ["a\x00\x00\x00b", "\U0001f600\U0010ffff\ue000xyz", "ab", "", None, "abcdef", "xabcdefx"]
    df = build(spark, [str(i) for i in range(len(texts))], system="s", version="1", level="a", label="l", description=texts, status="current", source="x")
    made = search_index.build(df, f"file://{tmp_path}/i", 1 << 20, 64)
    for q in ("\x00\x00\x00b", "\U0010ffff\ue000x", "abcdef", "bcdefx", "\U0001f600\U0010ffff\ue000xyz"):
        assert [r["code"] for r in made.search(q).collect()] == [str(i) for i, t in enumerate(texts) if t and q in t], q


def test_an_index_of_another_format_is_refused(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"shift": 1, "rows": 1, "slots": 2048}')
    with pytest.raises(ValueError, match="format"):
        search_index.SearchIndex(spark, f"file://{tmp_path}")


def test_pages_need_no_tables_of_searches(spark, data, small, tmp_path):
    made = search_index.build(data, f"file://{tmp_path}/i", 9000, 600, pages_only=True)
    assert not {"codes", "labels", "grams", "longer"} & {p.name for p in (tmp_path / "i").iterdir()}
    everything = [tuple(r)[:-1] for r in data.orderBy(ORD).collect()]
    assert [tuple(r)[:10] for r in made.page(5, 20).collect()] == everything[100:120]
    with pytest.raises(ValueError, match="pages only"):
        made.search("red")
    with pytest.raises(ValueError, match="pages only"):
        made.entry("K10")
    assert fixtures.paged(spark, small).pages_only


def test_grams_leave_a_task_once_for_64_blocks(spark, monkeypatch):
    """However many characters the blocks have; otherwise rows of the shuffle grow with the characters."""
    monkeypatch.setattr(search_index, "HELD", 50, raising=False)
    left = []
    monkeypatch.setattr(search_index, "map_arrow", lambda df, run, schema, f=search_index.map_arrow: left.append(f(df, run, schema)) or left[-1])
    rows = [(i, "description", f"common words of text {i % 7} and more") for i in range(130)]
    texts = spark.createDataFrame(rows, "block long, field string, text string").coalesce(1)
    for slots, grams in ((None, lambda t: {t[i : i + 3] for i in range(len(t) - 2)}), (1 << 16, lambda t: set(search_index.slots_of(t, 1 << 16).tolist()))):
        want = {}
        for block, _, t in rows:
            for g in grams(t):
                want[g, block >> 6] = want.get((g, block >> 6), 0) | 1 << (block & 63)
        found = search_index._bits(texts, slots).collect()
        assert {(r["gram"], r["word"]): r["mask"] % (1 << 64) for r in found} == want
        assert left[-1].count() == len(want)


def test_published_lists_are_indexed_for_searches_only(spark, small):
    store = fixtures.published(spark, f"{small}/")
    assert store.index("psic", "2026") is None
    assert fixtures.published_indexed(spark, f"{small}/").index("psic", "2026").search("widget", None, 3) is not None
