"""The pipeline's near-duplicate stage against brute force by exact Jaccard similarity."""

from pyspark.sql import functions as F

import corpus_pipeline
from codeatlas.llm import minhash, simhash


def test_near_copies_beyond_two_bits_leave_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
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
    got = sorted(r["doc_id"] for r in corpus_pipeline.distinct_content(spark, docs, small).collect())
    assert got == [rows[i]["doc_id"] for i in range(len(rows)) if find(i) == i]


def test_links_of_simhash_are_verified_and_joined(spark, monkeypatch):
    """SimHash counts repeated shingles, sets don't: two texts of one refrain have near fingerprints and differ as sets."""
    told, refrain = [], "x y z " * 80
    plain = " ".join(f"w{i}" for i in range(300))
    texts = [refrain + "one two three", refrain + "four five six", plain, plain + " w300"]
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 2

    def spied(marked, linked, run=minhash._told):
        found = run(marked, linked)
        told.append(found.count())
        return found

    monkeypatch.setattr(minhash, "_told", spied, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct_content(spark, docs, "").collect()) == [0, 1, 2]
    assert told and told[0] >= 1


def test_candidates_of_simhash_connect_what_near_duplicates_connects_directly(spark):
    """Rows of equal fingerprints, and a fingerprint with the smallest that it links to; each pair is within two bits."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join([*base, "end"]), "other words of a text on its own", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fp = {r["row"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    got = [(r["row"], r["keep_row"]) for r in simhash.candidates(docs).collect() if r["row"] != r["keep_row"]]
    assert all((fp[a] ^ fp[b]).bit_count() <= 2 for a, b in got)
    component = {r["row"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    root = {x: x for x in fp}
    for _ in fp:
        for a, b in got:
            root[a] = root[b] = min(root[a], root[b])
    assert all((root[a] == root[b]) == (component[a] == component[b]) for a in fp for b in fp)


def test_finished_steps_leave_no_shuffles(spark, monkeypatch):
    """What a step leaves on disk is released before the next large one."""
    asked = []
    monkeypatch.setattr(minhash, "released", lambda s: asked.append(s), raising=False)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h")], "doc_id long, text string")
    assert corpus_pipeline.distinct_content(spark, docs, "").count() == 2
    assert len(asked) >= 3


def test_small_steps_take_few_tasks(spark, monkeypatch):
    """What many shuffle partitions left of a small table is read by few tasks, in steps and in rounds of components; a large one by more."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base, *(f"x{j}" for j in range(i % 3))] if i < 9 else [f"v{i}-{j}" for j in range(30)])) for i in range(40)], "doc_id long, text string")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "")
        assert sorted(r["doc_id"] for r in corpus_pipeline.distinct_content(spark, docs, "").collect()) == [0, *range(9, 40)]
        status = spark.sparkContext.statusTracker()
        stages = {s for job in status.getJobIdsForGroup("few-tasks") for s in status.getJobInfo(job).stageIds}
        tasks = [info.numTasks for s in stages if (info := status.getStageInfo(s)) and info.numCompletedTasks]
        assert sum(n >= 64 for n in tasks) < 0.5 * len(tasks)
        many = spark.range(2000).groupBy((F.col("id") % 1000).alias("id")).count()
        few = minhash.gathered(many)
        assert few.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and few.count() == 1000
        monkeypatch.setattr("codeatlas.llm.common.TASK_BYTES", 100)
        assert minhash.gathered(many).rdd.getNumPartitions() == 64
        assert minhash.gathered(many.where("id < 0")).isEmpty()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
