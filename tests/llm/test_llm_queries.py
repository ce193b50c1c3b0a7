"""The registered queries that SQL can't express, against brute force on the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import minhash, quality, queries, sharding, simhash, toxicity
from codeatlas.llm.common import checkpointed, held_out


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def learned_from(spark, small, column):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return docs, spark.read.parquet(f"{small}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", column)


def test_op1_toxicity(spark, small, documents):
    model = toxicity.learn(*learned_from(spark, small, "toxic"))
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, small).collect()}
    assert set(got) == set(documents)
    for i, d in documents.items():
        text = toxicity.fold(d["text"])
        spans = [(at, at + len(e)) for e in model.exceptions for at in range(len(text)) if text.startswith(e, at)]
        hits = {}
        for term, weight in model.terms.items():
            at = text.find(term)
            while at >= 0:
                if len(term) > hits.get(at, (0, 0))[0]:
                    hits[at] = (len(term), weight)
                at = text.find(term, at + 1)
        free = [w for at, (n, w) in hits.items() if not any(a <= at and at + n <= b for a, b in spans)]
        total = sum(free)
        x = (math.log1p(total), math.log1p(100 * total / max(20, len(text.split())))) if total else (0.0, 0.0)
        r = got[i]
        assert r["hits"] == len(free) and r["score"] == pytest.approx(1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * x[0] + model.curve[2] * x[1]))), abs=1e-9)
        assert r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.5)


def test_op5_sharding(spark, small, documents):
    got = {r["doc_id"]: r for r in queries.op5_sharding(spark, small).collect()}
    assert set(got) == set(documents) and {r["law"] for r in got.values()} == {"bytes"}
    rows = spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), sharding.row_size(F.col("text")).alias("size"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
    groups = [r.asDict() for r in checkpointed(sharding._groups(rows)).collect()]
    target = sum(g["w"] for g in groups) / 40
    # only groups that no leaf can hold are dealt; all others go through a tree of its own here
    load, dealt = [0.0] * 40, {}
    for g in sorted((g for g in groups if g["w"] > target), key=lambda g: (-g["w"], g["key"])):
        parts = min(g["n"], 40 * 64, -(-g["w"] // (target / 16)))
        for _ in range(int(parts)):
            k = min(range(40), key=lambda s: (load[s], s))
            load[k] += g["w"] / parts
            dealt.setdefault(g["key"], []).append(k)
    room = [max(0.0, target - x) for x in load]
    from test_other import brute_tree

    leaf = brute_tree([g for g in groups if g["key"] not in dealt], room)
    keys = {r["id"]: r["key"] for r in rows.collect()}
    slots, held, shards = defaultdict(list), Counter(), defaultdict(set)
    for i, d in documents.items():
        r, data = got[i], (d["text"] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"] if keys[i] not in dealt else 0
        shards[keys[i]].add(r["shard"])
        assert keys[i] not in dealt or r["shard"] in dealt[keys[i]]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for k, v in shards.items() if k not in dealt)
    # repaired leaves are even, and most bytes lie where the tree has put them (five documents a shard here)
    scale = sum(room) / sum(g["w"] for g in groups if g["key"] in leaf)
    assert max(abs(held[i] - room[i] / scale) for i in range(40)) < 0.05 * target
    moved = sum(g["w"] for g in groups if g["key"] in leaf and shards[g["key"]] != {leaf[g["key"]]})
    assert moved < 0.4 * sum(g["w"] for g in groups if g["key"] in leaf)


def test_op7_fingerprints(spark, small, documents):
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, small).collect()}
    order = sorted(documents)
    hexed = lambda s: s.astype(">u2").tobytes().hex()
    for k, i in enumerate(order):
        a, b = documents[i]["text"] or "", documents[order[(k + 1) % len(order)]]["text"] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        x, y, z = (minhash.signature(minhash.shingles(t)) for t in (a, edited, b))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest(), hexed(x), hexed(y))
        assert r["near_edited"] == (x == y).mean() and r["near_next"] == (x == z).mean()


def test_op8_simhash(spark, small, documents):
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, small).collect()}
    ids = sorted(documents)
    fps = np.array([simhash.fingerprint((documents[i]["text"] or "").encode()) for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{int(fps[k]):016x}", ids[find(k)]) for k, i in enumerate(ids)}


def test_op9_quality(spark, small, documents):
    model = quality.learn(*learned_from(spark, small, "quality"))
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, small).collect()}
    assert set(got) == set(documents)
    e = {i: model.evidence(d["text"]) for i, d in documents.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p = {i: sigmoid(e[i] + model.prior) for i in e}
    site = {i: d["source"] or "" for i, d in documents.items()}
    path = {i: (site[i], d["lang"] or "") for i, d in documents.items()}

    def groups(of):
        out = defaultdict(list)
        for i, g in of.items():
            out[g].append(p[i])
        return out

    def strength(gs, within):
        n, m = sum(map(len, gs.values())), sum(map(sum, gs.values()))
        if not n or len(gs) < 2:
            return 1.0
        d = sum(len(v) * (np.mean(v) - within(g)) ** 2 for g, v in gs.items())
        v = sum(np.var(x) for x in gs.values())
        tau2 = max((d - v) / max(n - sum(len(x) ** 2 for x in gs.values()) / n, 1.0), 1e-9)
        return min(max(m / n * (1 - m / n) / tau2 - 1, 1.0), 1e6)

    sites, paths = groups(site), groups(path)
    mean = sum(p.values()) / len(p)
    k_site = strength(sites, lambda g: mean)
    k_path = strength(paths, lambda g: (sum(sites[g[0]]) + k_site * mean) / (len(sites[g[0]]) + k_site))
    for i, r in got.items():
        others = (sum(p.values()) - p[i]) / (len(p) - 1)
        site_mean = (sum(sites[site[i]]) - p[i] + k_site * others) / (len(sites[site[i]]) - 1 + k_site)
        path_mean = (sum(paths[path[i]]) - p[i] + k_path * site_mean) / (len(paths[path[i]]) - 1 + k_path)
        q = min(max(path_mean, 1e-6), 1 - 1e-6)
        assert r["evidence"] == pytest.approx(e[i], abs=1e-9) and r["path_mean"] == pytest.approx(path_mean, rel=1e-6)
        assert r["score"] == pytest.approx(sigmoid(e[i] + math.log(q / (1 - q))), abs=1e-6) and r["held_out"] == held(i)


def test_op10_packing(spark, small, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = queries.op10_packing(spark, small).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(documents)
    total = 0
    for i, d in documents.items():
        ids = np.array([*exact.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        first = len(ids) - (max(1, -(-len(ids) // 1024)) - 1) * 1024
        assert [(r["piece"], r["start"]) for r in mine] == [(0, 0), *enumerate(range(first, len(ids), 1024), 1)]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine) and sum(r["length"] for r in mine) == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    # the longest first, each to the tightest of all bins: what the bounded operator does within a block
    free: list[int] = []
    for n in sorted((r["length"] for r in out), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(1024 - n)
    assert len(sequences) == len(free) >= -(-total // 1024)
    assert max(Counter(r["sequence_id"] for r in out).values()) >= 1
