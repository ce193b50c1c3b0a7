import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm import common, exact_dedup, minhash, simhash
from codeatlas.llm.common import bitset, checkpointed, flag, lookup, numbered, single, without
from codeatlas.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, count int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows], SCHEMA)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def mixed_rows():
    rnd = random.Random(1)
    base = ["", "A", "a", "Ä", "ä", "same prefix " * 20 + "one", "same prefix " * 20 + "two", "x" * 50_000, "x" * 49_999 + "y"]
    rows = [(i, rnd.choice([*base, f"unique {i}"])) for i in range(200)]
    return [*rows, (200, None), (201, None), (None, "A"), (None, "alone"), (5, rows[5][1])]


def test_exact_verdicts_against_brute_force(spark):
    rows = mixed_rows()
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    got = exact_dedup.verdicts(frame(spark, rows), carry=[F.col("text"), F.col("count")]).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[low(r["text"])]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_exact_deduplicate_keeps_one_of_each_with_all_columns(spark):
    rows = mixed_rows()
    out = exact_dedup.deduplicate(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    texts = [low(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({low(t) for _, t in rows})


def test_exact_empty_table(spark):
    empty = frame(spark, []).limit(0)
    assert exact_dedup.verdicts(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_small_filters_only_cost_work(spark, monkeypatch):
    rows = mixed_rows()
    want, kept = exact_dedup.verdicts(frame(spark, rows)).collect(), exact_dedup.deduplicate(frame(spark, rows)).collect()
    monkeypatch.setattr(common, "MOST_BITS", 7)
    monkeypatch.setattr(common, "LEAST_BITS", 7)
    assert sorted(map(repr, exact_dedup.verdicts(frame(spark, rows), prefix=1).collect())) == sorted(map(repr, want))
    got = exact_dedup.deduplicate(frame(spark, rows), prefix=1).collect()
    assert sorted((low(r["text"]), repr(r["doc_id"])) for r in got) == sorted((low(r["text"]), repr(r["doc_id"])) for r in kept)


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a"), (1, "A"), (1, "a"), (2, "b"), (None, "c"), (None, "C"), (3, None), (3, "")] + [(4, "d")] * 9
    assert sorted((r["doc_id"] or -1, low(r["text"])) for r in exact_dedup.deduplicate(frame(spark, rows)).collect()) == [(-1, "c"), (1, "a"), (2, "b"), (3, ""), (4, "d")]


def test_lower_ascii_changes_no_other_capital(spark):
    texts = ["ABC xyz", "ÄÖ aB", "ä aB", "\u212a K", "Ⅷ A", "ⓐⒶ A", "ǅ D", "İ I", "ΣΑΣ S", "日本 Q", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.lower_ascii(F.col("t")).alias("x")).collect()
    assert all(r["x"] == low(r["t"]) for r in got)


def test_long_texts_differ_by_their_last_character(spark):
    rows = [(1, "long " * 300_000 + "x"), (2, "long " * 300_000 + "y"), (3, "LONG " * 300_000 + "x")]
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.verdicts(frame(spark, rows)).collect()} == {1: 3, 2: 2, 3: 3}
    assert len({r["fp"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}) == 1
    assert {r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {1, 2}  # four shingles: six in all


def test_bitset_never_misses(spark):
    keys = spark.createDataFrame([(i * 7919 - 5000,) for i in range(300)], "k long")
    words = bitset(keys, "k", 10)
    assert words.count() <= 16
    assert flag(keys, words, F.col("k"), 10, "in").where("not in").count() == 0
    assert flag(keys, words, F.lit(None).cast("long"), 10, "in").where("in").count() == 0


def test_lookup_hot_cold_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 900 else None if i < 950 else f"k{i}") for i in range(3000)], "i long, k string")
    groups = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    got = lookup(rows, checkpointed(groups), "k", "n", 2950, F.col("i"))
    assert got.count() == 3000 and got.where("k is null and n is null").count() == 50
    assert got.where("k = 'hot' and n = 900 and first = 0").count() == 900 and got.where("k like 'k%' and n = 1 and first = i").count() == 2050


@pytest.mark.parametrize("bits", [6, 20])
def test_without_and_single(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "LEAST_BITS", bits)
    monkeypatch.setattr(common, "MOST_BITS", bits)
    rows = spark.createDataFrame([(i, str(i % 50) if i % 100 else None) for i in range(500)], "i long, key string")
    out = without(rows, spark.createDataFrame([("3",), ("7",), ("7",), ("none",)], "key string"), "key", rows)
    assert out.count() == 480 and out.where("key in ('3', '7')").count() == 0 and out.where("key is null").count() == 5
    once = single(rows, rows.where("key = '5'"), "key")
    assert once.count() == 491 and once.where("key = '5'").count() == 1
    assert without(rows, rows.limit(0), "key", rows).count() == single(rows, rows.limit(0), "key").count() == 500


def test_numbers_have_no_gap_whatever_the_blocks(spark):
    rows = checkpointed(spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)], "i long, k string"))
    for blocks in (1, 9):
        got = {}
        for r in numbered(rows, "k", ["i"], blocks, "at").collect():
            got.setdefault(r["k"], []).append(r["at"])
        assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 300


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components(spark, shape):
    rnd = random.Random(2)
    n = 120
    edges = {"random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(70)], "path": [(i, i + 1) for i in range(n - 1)], "star": [(n, i) for i in range(n)]}[shape]
    root = list(range(n + 1))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 1), (2, 2)], "a long, b long")).collect()}
    assert got == {i: find(i) for i in range(n + 1) if find(i) != i}


def brute_simhash(rows, threshold=2):
    fps = [simhash.fingerprint(None if t is None else t.encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        c = find(k)
        least[c] = min(least.get(c, 1 << 60), 1 << 59 if i is None else i)
    return fps, [least[find(k)] for k in range(len(rows))], len({find(k) for k in range(len(rows))})


def test_fingerprint_against_bit_counts():
    import xxhash

    for text in ["", "one", "one two", "A b c d", "x y z " * 50, "\x0bq\x1c w\xa0e r t"]:
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_long_texts_are_taken_in_blocks(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 64)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("codes", [simhash.FEW, simhash.MANY])
def test_anchors_meet_whenever_within_the_threshold(codes):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for _ in range(2):
        y ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    at, where = simhash.anchors(y.view(np.int64), 2, codes)
    visits = set(zip(at.tolist(), where.tolist(), strict=True))
    assert len(visits) == len(at)
    assert all((i, h) in visits for i, h in enumerate(simhash.home(x.view(np.int64), codes).tolist()))
    assert abs(len(at) / 400 - simhash.visits(2, codes)) < 0.1 * simhash.visits(2, codes)


def test_anchors_grow_with_the_fingerprints():
    assert simhash.load(10**6, 2, simhash.FEW) < 16 and simhash.load(10**11, 2, simhash.MANY) < 1024


def test_crowded_homes_take_the_code_of_more_anchors(spark):
    near = spark.createDataFrame([((1 << a | 1 << b) << 46,) for a in range(15) for b in range(a)], "fp long")
    assert simhash.code_for(near, 2, 1024) == simhash.FEW and simhash.code_for(near, 2, 100) == simhash.MANY


@pytest.mark.parametrize("cap, codes", [(1, simhash.FEW), (8, simhash.MANY), (1024, simhash.FEW), (1024, simhash.MANY)])
def test_links_lose_no_component(spark, cap, codes):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in centre]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, 2, cap, codes)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label, len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    signed = fps.view(np.int64)
    mine = [got.get(int(f), int(f)) for f in signed]
    assert len({(a, b) for a, b in zip(mine, label.tolist(), strict=True)}) == len(set(mine)) == len(set(label.tolist()))


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(8)]
    rows = [(i, base[i % 8] + (f" end{i}" if i % 3 else "")) for i in range(60)]
    rows += [(60, ""), (61, None), (62, "one"), (63, "ONE"), (None, base[0]), (None, "lonely text of five words"), (7, "other text of a known id")]
    fps, component, n = brute_simhash(rows)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    seen = sorted((-1 if r["id"] is None else r["id"], r["fp"] & (1 << 64) - 1, 1 << 59 if r["component_id"] is None else r["component_id"]) for r in got)
    assert seen == sorted((-1 if i is None else i, f, c) for (i, _), f, c in zip(rows, fps, component, strict=True))
    kept = simhash.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == n
    assert simhash.deduplicate(frame(spark, rows + rows[:5] + [(62, "one")] * 3)).count() == n
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [64, 1])
def test_minhash_near_duplicates_against_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    monkeypatch.setattr(minhash, "TURNS", 1)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = [[rnd.choice(words) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(48):
        w = list(base[i % 6])
        for _ in range(i // 12):
            w[rnd.randrange(300)] = "edited"
        rows.append((i, " ".join(w)))
    rows += [(48, ""), (49, None), (50, "short"), (None, " ".join(base[0]))]
    sets = [set(minhash.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / u if u else 1.0) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {}
    for k, (i, _) in enumerate(rows):
        want.setdefault(find(k), set()).add(-1 if i is None else i)
    got = {}
    for r in minhash.near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r["component_id"], set()).add(-1 if r["id"] is None else r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    kept = minhash.deduplicate(frame(spark, rows + rows[:4]))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(want)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_crowded_buckets_lose_no_verified_link(spark):
    rnd = random.Random(9)
    fresh = lambda n: [f"{rnd.getrandbits(20):x}" for _ in range(n)]
    template, rows = fresh(190), []
    for _ in range(80):
        shared = fresh(2)
        rows += [(len(rows) + i, " ".join(template + shared + fresh(22))) for i in range(2)]
    sets = [set(minhash.shingles(t).tolist()) for _, t in rows]
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all((like(i, j) >= 0.8) == (i // 2 == j // 2) for i in range(160) for j in range(i))
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(160)}
    texts = spark.createDataFrame([(bytes([i]), t) for i, t in rows], "text_key binary, text string")
    rare = minhash.rare_shingles(texts.select("text_key"), texts, 0.8)
    assert rare.agg(F.max("n")).first()[0] <= 64  # all 160 share the template
    pairs = {tuple(sorted((r["a"][0], r["b"][0]))) for r in minhash.all_pairs(rare.withColumn("root", F.col("text_key")), 0.8).collect()}
    assert {(i, i + 1) for i in range(0, 160, 2)} <= pairs


def test_prefixes_lose_no_pair_of_any_size(spark):
    rnd = random.Random(10)
    base = [f"{rnd.getrandbits(20):x}" for _ in range(60)]
    rows = [base[: rnd.randint(8, 60)] + [f"{rnd.getrandbits(20):x}" for _ in range(rnd.randint(0, 6))] for _ in range(120)] + [base[:4], base[:5], []]
    rows = [(bytes([i]), " ".join(w)) for i, w in enumerate(rows)]
    sets = [set(minhash.shingles(t).tolist()) for _, t in rows]
    texts = spark.createDataFrame(rows, "text_key binary, text string")
    rare = minhash.rare_shingles(texts.select("text_key"), texts, 0.8).withColumn("root", F.col("text_key"))
    got = {tuple(sorted((r["a"][0], r["b"][0]))) for r in minhash.all_pairs(rare, 0.8).collect()}
    want = {(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert len(want) > 100 and want <= got


def test_scripts_without_spaces_have_shingles():
    a, b = "今天天气很好我们一起去公园散步" * 20, "今天天气很好我们一起去公园散步" * 20 + "明天见"
    s, t = (minhash.signature(minhash.shingles(x)) for x in (a, b))
    assert minhash.likeness(s, t) > 0.5
    assert minhash.words_of("Ein Wort, 日本 wort") == ["ein", "wort,", "日", "本", "wort"]


def test_signatures_estimate_jaccard():
    a = " ".join(f"a{i}" for i in range(1000))
    b = " ".join(f"a{i}" for i in range(500, 1500))
    s, t = (minhash.signature(minhash.shingles(x)) for x in (a, b))
    assert abs(minhash.likeness(s, t) - 1 / 3) < 0.15 and minhash.likeness(s, s) == 1
    assert minhash.likeness(minhash.signature(minhash.shingles("")), s) < 0.05


def test_edits_follow_the_order_of_ids(spark):
    import hashlib

    rnd = random.Random(8)
    ids = rnd.sample(range(10_000), 120)
    texts = {i: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 6) + "é" for _ in range(rnd.randint(0, 60))) for i in ids}
    rows = [(i, texts[i] or None) for i in ids]
    order = sorted(ids)
    plain = frame(spark, rows).repartition(7)
    got = {}
    for part in (1 << 23, 600):
        ordered = minhash.in_order(plain, "doc_id", "text", part)
        assert ordered.where("not copy").count() == 120 and ordered.where("copy").count() == ordered.select("bucket").distinct().count()
    import codeatlas.llm.minhash as m

    small = m.in_order
    try:
        m.in_order = lambda d, i, t: small(d, i, t, 600)
        got = {r["doc_id"]: r for r in minhash.fingerprints_beside_edits(plain).collect()}
    finally:
        m.in_order = small
    assert set(got) == set(ids)
    for k, i in enumerate(order):
        a, b = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r = got[i]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        s = [minhash.signature(minhash.shingles(x)) for x in (a, edited, b)]
        assert r["near_edited"] == minhash.likeness(s[0], s[1]) and r["near_next"] == minhash.likeness(s[0], s[2])
    assert minhash.fingerprints_beside_edits(plain.limit(0)).count() == 0
    one = minhash.fingerprints_beside_edits(plain.where(F.col("doc_id") == ids[0])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    named = plain.select(F.format_string("doc-%05d", "doc_id").alias("doc_id"), "text")
    by_name = {r["doc_id"]: r for r in minhash.fingerprints_beside_edits(named).collect()}
    assert all(by_name[f"doc-{i:05d}"]["edited_sha256"] == got[i]["edited_sha256"] for i in ids)


def test_edits_with_null_and_repeated_ids(spark):
    rows = [(None, "first one two"), (None, "null two"), (4, "four"), (4, "four"), (9, None), (7, "x " * 200_000)]
    got = minhash.fingerprints_beside_edits(frame(spark, rows)).collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, (i for i, _ in rows)))
    assert {r["n_chars"] for r in got if r["doc_id"] == 7} == {400_000}


INTERNAL = ["__digest", "__key", "__maybe", "__again", "__word", "__mask", "__row", "__l1", "__l2", "__id", "__hot", "__cold", "__deal", "row", "keep_row", "count", "again", "a`b", "a b", "Text"]


@pytest.mark.parametrize("name", ["exact", "minhash", "simhash"])
def test_columns_named_like_internal_ones_pass_through(spark, name):
    run = {"exact": exact_dedup.deduplicate, "minhash": minhash.deduplicate, "simhash": simhash.deduplicate}[name]
    texts = ["a b c d e f g h", "a b c d e f g h", "A b c d e f g h", "other words stand here in a row", None, "", "a b c d e f g h"]
    rows = [(i, t, *[f"{c} {i}" for c in INTERNAL]) for i, t in enumerate(texts)]
    names = ["doc_id", "text", *INTERNAL]
    df = spark.createDataFrame([tuple(r) for r in rows], T.StructType([T.StructField(c, T.LongType() if c == "doc_id" else T.StringType()) for c in names]))
    plain = run(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id").collect()
    got = run(df)
    assert got.columns == names
    found = {r[0]: tuple(r) for r in got.collect()}
    assert set(found) == {r["doc_id"] for r in plain} and 1 < len(found) < len(rows)
    assert all(found[i] == rows[i] for i in found)
    # the text under a name of an operator's own, and two columns of one name
    got = run(df.toDF("doc_id", "__key", *["x"] * len(INTERNAL)), text_col="__key")
    assert got.columns == ["doc_id", "__key", *["x"] * len(INTERNAL)] and {r[0]: tuple(r) for r in got.collect()} == found


def test_sketches_rule_out_no_similar_pair(spark):
    rnd = random.Random(12)
    sentences = [[f"{rnd.getrandbits(20):x}" for _ in range(12)] for _ in range(60)]
    rows = []
    for i in range(120):  # a template's texts: far below the similarity, but for a few
        kept = [s for s in sentences if rnd.random() < 0.85]
        rows.append((i, " ".join(sum(kept, []))))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(sum(kept, []) + ["edited"])))
    sets = {i: np.unique(minhash.shingles(t)) for i, t in rows}
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    differ = lambda i, j: sum(int(x).bit_count() for x in (minhash.parity(sets[i]) ^ minhash.parity(sets[j])).view(np.uint64))
    pairs = [(i, j) for i, _ in rows for j, _ in rows if i < j]
    assert all(differ(i, j) <= len(np.setxor1d(sets[i], sets[j])) for i, j in pairs)
    want = {p for p in pairs if like(*p) >= 0.8}
    data = [(1, i, len(sets[i]), i, len(rows), *minhash.parity(sets[i]).tolist()) for i, _ in rows]
    names = ["bucket", "text_key", "shingles", "root", "n", *minhash.PARITIES]
    got = {(r["a"], r["b"]) for r in minhash.all_pairs(spark.createDataFrame(data, names), 0.8).collect()}
    assert want <= got and len(got) < len(pairs) / 20


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_of_a_bucket_meet_each_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(b, i, 5, i // 2, 20) for b in (1, 2) for i in range(20)]
    got = minhash.all_pairs(spark.createDataFrame(rows, "bucket long, text_key long, shingles long, root long, n long"), 0.8).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(i, j) for i in range(20) for j in range(i + 1, 20) if i // 2 != j // 2]
