"""Collocations, license scans and spelling variants against brute force on small tables."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from codeatlas.llm import collocations, licenses, queries, spelling

CLASHING = ["left", "right", "name", "n", "words", "word", "row", "blocks", "base", "block", "m", "i", "j", "h", "many", "x", "id", "score", "rank"]


def documents(spark, rows, clashing=False):
    """``doc_id, text, lang`` and columns whose names the operators use themselves."""
    extra = CLASHING if clashing else []
    schema = "doc_id long, text string, lang string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *["?"] * len(extra)) for r in rows], schema)


# collocations


def phrases_by_force(rows, first, most, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        longer = defaultdict(int)
        for p, a in counts.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least and 100 * longer[p] < 80 * a:
                score, _, x, y = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def random_rows(seed, docs=60, words=120):
    rng = random.Random(seed)
    vocabulary = ["A", "a", "of", "the", "Éa", "x1", " y", "zwölf", "漢字", "e\x00f"]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", "\t ", ". ", ",", "\n", " \r", "-"]) for _ in range(rng.randrange(words)))
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    return [*rows, (100, None, "en"), (101, "", None), (101, "of the of the", "en"), (101, "of the of the", "en"), (None, "the of a the of a", "fr")]


@pytest.mark.parametrize(("seed", "segment"), [(1, 1 << 22), (2, 50), (3, 7)])
def test_phrases_are_those_of_brute_force(spark, seed, segment):
    rows = random_rows(seed)
    got = collocations.collocations(documents(spark, rows, clashing=True), first=40, least=5, segment=segment)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_force(rows, 40, 4, 5)


def test_candidates_ranked_in_shares(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED_AT_ONCE", 10)
    rows = random_rows(4)
    got = collocations.collocations(documents(spark, rows), first=7, least=4)
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_force(rows, 7, 4, 4)


def test_a_long_text_is_counted_whole(spark):
    rows = [(1, "new york " * 40_000 + "w" * 300_000 + " new york", "en")]
    got = {r["phrase"]: r["a"] for r in collocations.collocations(documents(spark, rows), segment=1000).collect()}
    assert got["new york new york"] == 39_999


def test_no_phrases(spark):
    assert collocations.collocations(documents(spark, [])).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, None), (2, "a b. c", "en")])).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_segments_hold_every_phrase_once(size):
    rng = random.Random(size)
    text = b"".join(rng.choice([b"a", b"bb", b"cccccccccccccccc"]) + rng.choice([b" ", b"  ", b". ", b"\t"]) for _ in range(400))

    def phrases(t):
        return Counter(tuple(p.split()[i : i + size]) for p in t.split(b".") for i in range(len(p.split()) - size + 1))

    assert sum((phrases(s) for s in collocations.segments(text, size, 13)), Counter()) == phrases(text)


def test_products_beyond_64_bits(spark):
    a = 9 * 10**15
    level = spark.createDataFrame([(a, [a + 1, a], [a + 3, a])], "a long, firsts array<long>, lasts array<long>")
    assert collocations._scored(level, 2).first()["cut"]["score"] == 2000000 * a // (2 * a + 4)


def test_names_that_collide_are_an_error(spark):
    with pytest.raises(ValueError):
        collocations._distinct(spark.createDataFrame([(1,), (1,)], "name long"), 2)


# license scans


def found_by_force(text, templates, phrases, contained):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, score = {label for _, label in hits}, 1.0 if hits else 0.0
    for t in templates:
        s, whole = licenses.scale(t), set(licenses.words_of(t.text))
        for start in range(0, len(words), s):
            block = set(words[start : start + 2 * s])
            if len(block & whole) >= contained * len(whole) - 1e-9 and set(t.must) <= block and not set(t.unless) & block:
                labels.add(t.label)
                score = max(score, len(block & whole) / len(whole))
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), sorted({label for _, label in hits}), sorted(labels), score


def licensed_rows(seed):
    rng = random.Random(seed)
    filler = ["the", "of", "public", "general", "software", "version", "3", "is", "this", "work", "copy", "license", "Éa", "x_y", "漢字"]
    rows = []
    for i in range(80):
        words = [rng.choice(filler) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(licenses.TEMPLATES).text.split()
            kept = [w for w in t if rng.random() > rng.choice([0, 0.1, 0.2, 0.3])]
            if rng.random() < 0.3:
                rng.shuffle(kept)
            at = rng.randrange(len(words) + 1)
            words[at:at] = kept
        if rng.random() < 0.4:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(["Under the MIT License", "Apache-License; version 2.0", "CC BY-NC 4.0", "under the mit", "cc-by nc"]).split()
        rows.append((i, " ".join(words), "en"))
    return [*rows, (200, None, None), (201, "", "en"), (202, "cc by", "x"), (203, "nc", "x"), (204, "CC BY-NC", None), (204, "CC BY-NC", None), (None, "under THE mit license " * 3, "x"), (205, "--- !!", "x")]


@pytest.mark.parametrize(("seed", "contained"), [(1, 0.8), (2, 0.6), (3, 1.0)])
def test_labels_are_those_of_brute_force(spark, seed, contained):
    rows = licensed_rows(seed)
    got = licenses.scan(documents(spark, rows, clashing=True), contained=contained).collect()
    want = [(i, *found_by_force(text, licenses.TEMPLATES, licenses.PHRASES, contained)) for i, text, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_a_long_text_is_scanned_whole(spark):
    notice = licenses.TEMPLATES[2].text
    r = licenses.scan(documents(spark, [(1, "word " * 400_000 + notice, "en")])).first()
    assert r["n_words"] == 400_000 + len(licenses.words_of(notice)) and r["labels"] == ["apache-2"] and r["first_word"] >= 400_000


def test_templates_and_tables_may_be_empty(spark):
    assert licenses.scan(documents(spark, [])).collect() == []
    r = licenses.scan(documents(spark, [(1, "under the MIT license", "en")]), templates=[licenses.TEMPLATES[0]], phrases={}).first()
    assert r["n_base"] == 0 and r["labels"] == [] and r["score"] == 0.0


def test_every_template_is_found_in_its_own_text_and_needs_its_words(spark):
    rows = [(i, t.text, "en") for i, t in enumerate(licenses.TEMPLATES)]
    got = {r["id"]: r for r in licenses.scan(documents(spark, rows), phrases={}).collect()}
    for i, t in enumerate(licenses.TEMPLATES):
        assert got[i]["labels"] == [t.label] and got[i]["score"] == 1.0


# spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_force(words, times=10):
    near = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def counted_by_force(rows, shortest, least):
    found = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


@pytest.mark.parametrize(("seed", "crowded", "letters"), [(1, 64, "ab"), (2, 2, "ab"), (3, 5, "abÀ÷"), (4, 3, "a")])
def test_near_words_are_those_of_brute_force(spark, seed, crowded, letters):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(3, 10))): rng.choice([2, 3, 30, 31, 400, 5000]) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near(df, shortest=3, crowded=crowded).collect()}
    want = {}
    for a in words:
        if near := [b for b in words if one_edit(a, b)]:
            best = min(near, key=lambda x: (-words[x], x))
            want[a] = (len(near), best, words[best])
    assert got == want


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeéÉ") for _ in range(rng.randrange(7, 14))) for _ in range(12)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(60)):
            w = stems[min(11, int(rng.expovariate(0.6)))]
            while rng.random() < 0.06:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :]])
            words.append(rng.choice([w, w.capitalize(), w.upper()]))
        rows.append((rng.choice([i, i, None]), rng.choice([" ", "-", "ß9", ". ", "Ā"]).join(words), "en"))
    rows += [(1, None, None), (2, "", "x"), (3, "abcdefg abcdefg", "x"), (3, "abcdefg abcdefg", "x"), (4, "q" * 5000 + " " + "q" * 5001 + " " + "q" * 5001, "x"), (5, "q" * 5000, "x")]
    want = variants_by_force(counted_by_force(rows, 7, 2))
    got = spelling.variants(documents(spark, rows, clashing=True), crowded=4)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8])
def test_roots_end_every_chain(spark, length):
    links = [(f"{c}{i}", f"{c}{i + 1}") for c in "ab" for i in range(length)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: f"{w[0]}{length}" for w, _ in links}


def test_a_chain_of_forms(spark):
    rows = [(i, " ".join(["chainword"] * 400 + ["chainwords"] * 35 + ["chainwordss"] * 3), "en") for i in range(3)]
    got = {r["word"]: r for r in spelling.variants(documents(spark, rows)).collect()}
    want = {r[0]: r for r in variants_by_force(counted_by_force(rows, 7, 2))}
    assert {w: tuple(r) for w, r in got.items()} == want
    assert got["chainwordss"]["form"] == "chainwords" and got["chainwordss"]["root"] == "chainword"


def test_no_words(spark):
    assert spelling.variants(documents(spark, [])).collect() == []
    assert spelling.variants(documents(spark, [(1, None, "en"), (2, "short words only", "en")])).collect() == []


def test_crowded_blocks_are_divided(spark):
    words = ["abcdefg" + a + b for a in "abcdefghijkl" for b in "abcdefghijkl"]
    found = spelling.blocks(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), crowded=10).collect()
    by = Counter(r["block"] for r in found)
    open_ends = {b: int(m) - int(i) - int(j) for b in by for m, i, j, _ in [b.split(",", 3)]}
    assert all(n <= 10 or open_ends[b] == 1 for b, n in by.items())


def test_op13_spelling(spark, small):
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_spelling(spark, small).collect()) == variants_by_force(counted_by_force(rows, 7, 2))
