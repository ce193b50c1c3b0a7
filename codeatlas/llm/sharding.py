"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

A node with several shards is split along its widest dimension (source, language, size, id) so that the
bytes on either side are in proportion to the shards there, until a leaf is one shard: a number of shards, or as many as
the target bytes need.  The weighted median is found on a total order by histograms of at most ``BINS`` bins a node,
narrowed until a bin is a small part of a shard.  Only histograms come to the driver.

Equal texts are one group and go to one shard.  Every group goes through the tree but those that are heavier than a shard, which no leaf
can hold: they are dealt first, the largest to the emptiest shard, and the tree fills what is left.  Of these, one heavier than ``split_over`` shards
(1: a whole shard) can't stay whole without making its shard heavier than the others: it is dealt in parts, its rows in turn.

A split falls between two groups, so leaves differ by parts of a group.  Where that is more than ``EVEN`` of a shard, leaves are repaired:
single groups move from a leaf above the mean to one below, or change places, a few hundred bytes to a few kilobytes at a time.  Which ones is
decided on a few groups of each size class of the leaves concerned; leaves of many small groups need no repair.

Defined cases: a null text has size 16 (a row's overhead), null metadata counts as empty or zero.  Groups with equal
coordinates are ordered by a hash of the text.  Long texts are weighed whole.  Rows that repeat an id are placed each.  Empty
tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, lookup, numbered

BINS = 2048
OVERHEAD = 16
#: What leaves may differ from their share of the bytes, in shards, without repair; a split comes as near to the weighted median.
EVEN = 0.002
#: Groups of a size class (half a power of two) that a leaf offers, leaves repaired at a time, and how often.
OFFERED, REPAIRED, REPAIRS = 16, 1000, 8


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _coordinate(value: Column) -> Column:
    """A dimension's value below 2**30, and below it a hash of the group, so that any two groups differ in order."""
    return F.shiftleft(F.coalesce(value, F.lit(0)).cast("long"), 32) + F.pmod(F.xxhash64("key"), F.lit(1 << 32))


def _groups(rows: DataFrame) -> DataFrame:
    dims = {
        "d_source": F.pmod(F.xxhash64(F.min("source")), F.lit(1 << 30)),
        "d_lang": F.pmod(F.xxhash64(F.min("lang")), F.lit(1 << 30)),
        "d_size": F.least(F.lit((1 << 30) - 1), F.floor(F.log2(F.max("size").cast("double")) * (1 << 24))),
        "d_id": F.pmod(F.min("id"), F.lit(1 << 30)),
    }
    grouped = rows.groupBy("key").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *[d.alias(k) for k, d in dims.items()])
    return grouped.select("key", "w", "n", *[_coordinate(F.col(k)).alias(k) for k in dims])


DIMENSIONS = ("d_source", "d_lang", "d_size", "d_id")


def _deal(big: list[tuple[int, int, int]], shards: int, target: float, split_over: float) -> tuple[dict[int, list[int]], list[float]]:
    """For each big group the shards of its parts, and every shard's load: largest part to the emptiest shard."""
    load, out = [0.0] * shards, {}
    emptiest = [(0.0, i) for i in range(shards)]
    for key, w, n in sorted(big, key=lambda x: (-x[1], x[0])):
        parts = 1 if w <= target * split_over else min(n, 64 * shards, int(-(-w // (target / 16))))
        out[key] = []
        for _ in range(parts):
            _, s = emptiest[0]
            load[s] += w / parts
            heapq.heapreplace(emptiest, (load[s], s))
            out[key].append(s)
    return out, load


def _along(dim: Column) -> Column:
    return F.coalesce(*[F.when(dim == d, F.col(d)) for d in DIMENSIONS])


def _bounds(groups: DataFrame) -> dict:
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    return {r["node"]: r.asDict() for r in groups.groupBy("node").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"), *ends).collect()}


def _split_points(groups: DataFrame, goals: dict[int, tuple[str, int, int, float]], exact: float) -> dict[int, tuple[str, int]]:
    """By node, the dimension and the value where the weight below is nearest to the goal.

    ``goals``: by node its dimension, lowest and highest value, and the weight wanted below the split.
    """
    spark, done = groups.sparkSession, {}
    open_ = {node: (dim, lo, hi, 0.0, goal) for node, (dim, lo, hi, goal) in goals.items()}
    while open_:
        params = spark.createDataFrame([(n, d, lo, hi, max(1, -(-(hi - lo + 1) // BINS))) for n, (d, lo, hi, _, _) in open_.items()], "node long, dim string, lo long, hi long, step long")
        inside = groups.join(F.broadcast(params), "node").withColumn("v", _along(F.col("dim"))).where("v between lo and hi")
        hist = inside.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("w").alias("w"), F.min("v").alias("first"), F.max("v").alias("last")).collect()
        by_node: dict[int, list] = {}
        for r in hist:
            by_node.setdefault(r["node"], []).append((r["bin"], r["w"], r["first"], r["last"]))
        for node, (dim, lo, hi, below, goal) in list(open_.items()):
            at, split = below, hi + 1
            for _, w, first, last in sorted(by_node.get(node, [])):
                if at + w > goal:
                    if first < last and w > exact:  # go on between the values that are there
                        open_[node], split = (dim, first, last, at, goal), None
                    else:
                        split = first if goal - at <= at + w - goal else last + 1
                    break
                at += w
            if split is not None:
                done[node] = (dim, split)
                del open_[node]
    return done


def tree(groups: DataFrame, room: list[float], exact: float) -> DataFrame:
    """``key, n, shard`` of ``groups``: the leaf of the tree whose leaves have ``room`` in proportion.

    A split is looked for until the bin it falls into weighs no more than ``exact``.
    """
    spark = groups.sparkSession
    ranges = {0: (0, len(room))}
    groups = checkpointed(groups.withColumn("node", F.lit(0).cast("long")))
    root = None
    while any(b - a > 1 for a, b in ranges.values()):
        seen = _bounds(groups)
        root = root or seen.get(0)
        goals = {}
        for node, (a, b) in ranges.items():
            if b - a > 1 and node in seen:
                x = seen[node]
                width = {d: (x[f"max_{d}"] - x[f"min_{d}"]) / max(1, root[f"max_{d}"] - root[f"min_{d}"]) for d in DIMENSIONS}
                dim = max(DIMENSIONS, key=lambda d: width[d])
                mid, whole = (a + b) // 2, sum(room[a:b])
                share = sum(room[a:mid]) / whole if whole > 0 else (mid - a) / (b - a)
                goals[node] = (dim, x[f"min_{dim}"], x[f"max_{dim}"], x["w"] * share)
        splits = _split_points(groups, goals, exact)
        children = {}
        for node, (a, b) in ranges.items():
            if b - a == 1:
                children[node] = (a, b)
            else:
                children |= {2 * node + 1: (a, (a + b) // 2), 2 * node + 2: ((a + b) // 2, b)}
        # a row for each node that is split, at most one a shard
        cuts = spark.createDataFrame([(node, dim, v) for node, (dim, v) in splits.items()], "node long, dim string, cut long")
        right = (_along(F.col("dim")) >= F.col("cut")).cast("long")
        stepped = groups.join(F.broadcast(cuts), "node", "left").withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + right))
        groups = checkpointed(stepped.select(groups.columns))
        ranges = children
    leaves = spark.createDataFrame([(node, a) for node, (a, _) in ranges.items()], "node long, shard int")
    return groups.join(F.broadcast(leaves), "node").select("key", "n", "w", "shard")


def _moves(load: dict[int, float], offers: dict[int, list[tuple[int, int]]], even: float) -> dict[int, int]:
    """By key the new leaf of a few groups, so that the ``load`` above the room of the leaves comes near to 0; ``load`` and ``offers`` follow.

    Of the heaviest leaf a group moves to the lightest, or changes places with a lighter one there: what comes nearest to half of their difference.
    """
    moved: dict[int, int] = {}
    for held in offers.values():
        held.sort()
    settled: set[tuple[int, int]] = set()
    while True:
        pair = None
        light_first = sorted(load, key=lambda x: (load[x], x))
        for heavy in reversed(light_first):
            if load[heavy] <= even and load[light_first[0]] >= -even:
                break
            for light in light_first:
                if load[heavy] - load[light] <= even:
                    break
                if (heavy, light) not in settled:
                    pair = (heavy, light)
                    break
            if pair:
                break
        if pair is None:
            return moved
        heavy, light = pair
        half, best = (load[heavy] - load[light]) / 2, None
        others = [(0, None), *offers[light]]
        weights = [w for w, _ in others]
        for w, key in offers[heavy]:
            # against each group the best partner is next to the weight that would even the leaves out
            at = bisect.bisect_left(weights, w - half)
            for i in (at - 1, at):
                if 0 <= i < len(others) and 0 < w - weights[i] < 2 * half:
                    off = abs(half - (w - weights[i]))
                    if best is None or off < best[0]:
                        best = (off, w, key, *others[i])
        # a step that hardly helps is none: each one takes an eighth of the difference at least
        if best is None or half - best[0] < half / 8:
            settled.add(pair)
            continue
        _, w, key, back, other = best
        offers[heavy].remove((w, key))
        bisect.insort(offers[light], (w, key))
        moved[key] = light
        if other is not None:
            offers[light].remove((back, other))
            bisect.insort(offers[heavy], (back, other))
            moved[other] = heavy
        load[heavy], load[light] = load[heavy] - (w - back), load[light] + (w - back)
        settled = {p for p in settled if not {heavy, light} & set(p)}


def repaired(placed: DataFrame, room: list[float], target: float) -> DataFrame:
    """``key, n, shard`` of ``placed`` (``key, n, w, shard``), leaves as heavy as their ``room`` but for ``EVEN`` of a shard, as far as single groups allow."""
    spark, even = placed.sparkSession, EVEN * target
    for _ in range(REPAIRS):
        load = {i: -x for i, x in enumerate(room)}
        for r in placed.groupBy("shard").agg(F.sum("w").alias("w")).collect():
            load[r["shard"]] += r["w"]
        off = sorted(load, key=lambda x: (-abs(load[x]), x))[:REPAIRED]
        if len(load) < 2 or abs(load[off[0]]) <= even:
            break
        concerned = spark.createDataFrame([(i,) for i in off], "shard int")
        size = F.floor(2 * F.log2("w"))
        few = F.row_number().over(W.partitionBy("shard", size).orderBy("key"))
        held: dict[int, list[tuple[int, int]]] = {i: [] for i in off}
        for r in placed.join(F.broadcast(concerned), "shard").withColumn("few", few).where(F.col("few") <= OFFERED).select("shard", "w", "key").collect():
            held[r["shard"]].append((r["w"], r["key"]))
        moved = _moves({i: load[i] for i in off}, held, even)
        if not moved:
            break
        new = spark.createDataFrame(list(moved.items()), "key long, moved_to int")
        placed = checkpointed(placed.join(F.broadcast(new), "key", "left").select("key", "n", "w", F.coalesce("moved_to", "shard").alias("shard")))
    return placed.select("key", "n", "shard")


def assign(
    docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    target_bytes: int | None = None, split_over: float | None = 1.0, block_rows: int = 20_000,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size, text_crc32, shard, slot``; slots of a shard have no gap from 0.

    Give the number of ``shards``, or ``target_bytes`` for as many as keep to these.  Groups of equal texts heavier than ``split_over``
    shards are split; None keeps every group whole, and one shard heavier than the others where a group is.  Rows are
    numbered in blocks of about ``block_rows``.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give a number of shards or target bytes")
    text = F.coalesce(text_col, F.lit(""))
    number = F.col(id_col) if dict(docs.dtypes)[id_col] in ("bigint", "int") else F.xxhash64(id_col)
    rows = docs.select(
        F.col(id_col).alias("id"), number.cast("long").alias("order"), F.xxhash64(text).alias("key"), row_size(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(source_col, F.lit("")).alias("source"), F.coalesce(lang_col, F.lit("")).alias("lang"),
    )
    rows = checkpointed(rows)
    groups = checkpointed(_groups(rows.withColumn("id", F.coalesce("order", F.lit(0)))))
    total, n = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = shards or max(1, -(-total // target_bytes))
    target = max(1.0, total / shards)
    # heavier than a leaf: fewer than there are shards
    big = groups.where(F.col("w") > F.lit(target)).select("key", "w", "n")
    big = [tuple(r) for r in big.collect()]
    parts, load = _deal(big, shards, target, float("inf") if split_over is None else split_over)
    room = [max(0.0, target - x) for x in load]
    dealt = rows.sparkSession.createDataFrame([(k, v) for k, v in parts.items()], "key long, shards array<int>")
    small = repaired(tree(groups.join(F.broadcast(dealt), "key", "left_anti"), room, target * EVEN), room, target)
    first = rows.join(F.broadcast(dealt), "key", "left").select("id", "order", "size", "text_crc32", "key", "shards")
    # the parts of a group: in turn
    several = F.size("shards") > 1
    split = checkpointed(first.where(several))
    turn = F.pmod(F.col("turn"), F.size("shards")).cast("int")
    split = numbered(split, "key", ["order", "text_crc32"], n // block_rows, "turn").withColumn("dealt", F.get("shards", turn)).drop("turn")
    first = first.where(~F.coalesce(several, F.lit(False))).withColumn("dealt", F.get("shards", F.lit(0))).unionByName(split)
    first = first.withColumn("key", F.when(F.col("shards").isNull(), F.col("key"))).drop("shards")
    placed = lookup(first, small, "key", "n", n, F.col("id")).withColumn("shard", F.coalesce("dealt", "shard"))
    placed = checkpointed(placed.select("id", "order", "size", "text_crc32", "shard"))
    slots = numbered(placed, "shard", ["order", "size", "text_crc32"], n // (shards * block_rows), "slot")
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
