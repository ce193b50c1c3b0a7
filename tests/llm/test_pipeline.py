"""The pipeline's stages against brute force, and the registered queries against DuckDB, on the smallest tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from codeatlas.llm import minhash, packing, queries, toxicity


@pytest.fixture(scope="module")
def staged(spark, small, tmp_path_factory):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs)
    return [t.collect() for t in tables], [t.columns for t in tables]


def test_stages_are_the_dealt_operators(staged):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    _, columns = staged
    assert all(c == columns[0] for c in columns[:-1])


def test_toxicity_keeps_clean_documents(staged, spark, small):
    (before, after, *_), _ = staged
    kept = {r["doc_id"] for r in after}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    seeds = [w for w in toxicity.SEED if w in ("idiot", "moron", "stupid", "worthless", "scum")]
    rude = [r["doc_id"] for r in before if any(f" {toxicity.fold(w).strip()} " in toxicity.fold(r["text"]) for w in seeds)]
    assert rude and sum(i not in kept for i in rude) >= 0.9 * len(rude)


def test_exact_dedup_keeps_the_largest_id(staged):
    (_, before, after, *_), _ = staged
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for r in before:
        best[low(r["text"])] = max(best.get(low(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())


def test_near_dedup_keeps_the_smallest_id_of_each_component(staged):
    (_, _, before, after, *_), _ = staged
    rows = sorted(before, key=lambda r: r["doc_id"])
    sets = [set(minhash.shingles(r["text"]).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / u if u else 1.0) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in after) == sorted(rows[i]["doc_id"] for i in range(len(rows)) if find(i) == i)


def test_mixing_repeats_no_source_beyond_its_limit(staged):
    (_, _, _, before, after, _), _ = staged
    tokens = lambda rows: Counter({s: sum(-(-max(1, len((r["text"] or "").encode())) // 4) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    a, b = tokens(before), tokens(after)
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    assert all(a[s] <= b[s] <= 2 * a[s] + 1 for s in a)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_packing_lays_out_every_token(staged):
    (*_, before, packed), _ = staged
    assert sum(r["length"] for r in packed) == sum(len(packing.encode(r["text"] or "")) + 1 for r in before)
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_duckdb(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    df = queries.QUERIES[name](spark, small)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(r[columns.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_mixing", "op6_chat"])
def test_native_queries_have_no_python(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_run_is_the_stages(spark, small, staged):
    tables, _ = staged
    assert corpus_pipeline.run(spark, small).count() == len(tables[-1])
