import random

from codeatlas.operators.hierarchy import ancestors, parent_by_prefix, parent_by_zero_suffix


def parents(df):
    return {(r["version"], r["level"], r["code"]): r["parent_code"] for r in df.collect()}


def lists(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "system string, version string, level string, code string")


def test_prefix_chain_and_scope(spark):
    rows = [("1", "a", "1"), ("1", "b", "11"), ("1", "c", "111"), ("1", "d", "1111"), ("2", "a", "2"), ("2", "b", "11"), ("1", "c", "9"), ("1", "d", "1"), ("1", "d", "2111")]
    got = parents(parent_by_prefix(lists(spark, rows), ["a", "b", "c", "d"]))
    assert got[("1", "d", "1111")] == "111" and got[("1", "c", "111")] == "11" and got[("1", "b", "11")] == "1" and got[("1", "a", "1")] is None
    assert got[("2", "b", "11")] is None  # its parent exists in the other edition only
    assert got[("1", "c", "9")] is None and got[("1", "d", "1")] is None and got[("1", "d", "2111")] is None


def test_prefix_looks_one_level_up_only(spark):
    rows = [("1", "a", "01"), ("1", "c", "0111"), ("1", "b", "02")]
    assert parents(parent_by_prefix(lists(spark, rows), ["a", "b", "c"]))[("1", "c", "0111")] is None


def test_repeated_codes_do_not_multiply(spark):
    rows = [("1", "a", "1"), ("1", "a", "1"), ("1", "b", "12"), ("1", "b", "12")]
    out = parent_by_prefix(lists(spark, rows), ["a", "b"]).collect()
    assert len(out) == 4 and {r["parent_code"] for r in out if r["level"] == "b"} == {"1"}
    zero = parent_by_zero_suffix(lists(spark, [("1", "x", "10"), ("1", "x", "10"), ("1", "y", "11")])).collect()
    assert len(zero) == 3


def test_zero_suffix_chain(spark):
    chain = ["1001301001", "1001301000", "1001300000", "1000000000"]
    got = parents(parent_by_zero_suffix(lists(spark, [("1", "x", c) for c in [*chain, "1380100000", "1300000000"]])))
    assert [got[("1", "x", c)] for c in chain] == [*chain[1:], None]
    assert got[("1", "x", "1380100000")] == "1300000000" and got[("1", "x", "1300000000")] == "1000000000"


def test_one_character_codes(spark):
    rows = lists(spark, [("1", "a", "1"), ("1", "b", "2")])
    assert set(parents(parent_by_zero_suffix(rows)).values()) == {None}
    assert set(parents(parent_by_prefix(rows, ["a", "b"])).values()) == {None}


def test_random_lists_against_a_loop(spark):
    rnd = random.Random(5)
    levels = ["a", "b", "c"]
    rows = list({(v, lv, "".join(rnd.choice("01") for _ in range(rnd.randint(1, 7)))) for v in "12" for lv in levels for _ in range(60)})
    by = {(v, lv): {c for w, x, c in rows if (w, x) == (v, lv)} for v in "12" for lv in levels}
    want = {}
    for v, lv, c in rows:
        i = levels.index(lv)
        want[(v, lv, c)] = next((c[:k] for k in range(len(c) - 1, 0, -1) if i and c[:k] in by[(v, levels[i - 1])]), None)
    assert parents(parent_by_prefix(lists(spark, rows), levels)) == want
    known = {v: {c for w, _, c in rows if w == v} for v in "12"}
    zero = {(v, lv, c): next((o for k in range(1, len(c)) if (o := c[: len(c) - k] + "0" * k) != c and o in known[v]), None) for v, lv, c in rows}
    assert parents(parent_by_zero_suffix(lists(spark, rows))) == zero


def test_candidates_are_merged_not_broadcast(spark):
    rows = lists(spark, [("1", "a", "10"), ("1", "b", "1011"), ("1", "b", "1012")])
    for found in (parent_by_prefix(rows, ["a", "b"]), parent_by_zero_suffix(rows)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("SortMergeJoin") == 2
        assert not any("Generate" in part.split("BroadcastHashJoin")[0] for part in plan.split("BroadcastExchange")[1:])


def test_prefixes_of_several_lengths_above(spark):
    rows = [("1", "a", c) for c in ("1", "12", "1234", "1235")] + [("1", "b", c) for c in ("12345", "1299", "1", "12", "é1")]
    got = parents(parent_by_prefix(lists(spark, rows), ["a", "b"]))
    assert [got[("1", "b", c)] for c in ("12345", "1299", "1", "12", "é1")] == ["1234", "12", None, "1", None]


def test_ancestors(spark):
    df = spark.createDataFrame([("1", "A", "a", None), ("11", "B", "b", "1"), ("111", "C", "c", "11")], "code string, label string, level string, parent_code string")
    assert [r["code"] for r in ancestors(df, "111").orderBy("step").collect()] == ["111", "11", "1"]
