"""Mixing sources to target weights by temperature.

Shares of tokens by source are raised to an exponent between 0 and 1 and normalised.  The exponent is
bisected on a fixed grid: the largest whose entropy reaches a target, or the smallest that repeats no
source more than a limit allows.  A smaller exponent flattens the mixture.

The weights are realised as block permutations under a budget of tokens: every source is cut into
blocks of documents by a hash, each pass over a source takes its blocks in a permutation of its own,
and the last pass takes blocks in its order until the source's budget is used up; only inside the block
where that happens documents are counted one by one.  Rows come out with their pass and their place in it;
``in_order`` lays them out so.

Tokens are estimated from bytes: an exact count is the tokenizer's, which is no SQL.  Only shares of tokens matter
here, so a factor that sources have in common changes nothing.

Defined cases: null and empty texts have no tokens but count one, so that every document has a place; long texts count
whole.  A null source is a source of its own, the empty string.  Rows that repeat an id are realised each.  Blocks with
equal hashes go by number, documents with equal hashes by a hash of id and text.  An empty table gives an empty
result; extra columns pass through ``mix``, and columns added are named with two underscores before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, lookup

#: Steps of the exponent between 0 and 1.
GRID = 1024


def n_tokens(text: Column) -> Column:
    """Bytes of the text over four, rounded up, at least one: what a byte-pair vocabulary takes, roughly."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def shares(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, tokens, documents`` by source."""
    return docs.groupBy(F.coalesce(source_col, F.lit("")).alias("source")).agg(
        F.sum(n_tokens(F.col(text_col))).alias("tokens"), F.count(F.lit(1)).alias("documents")
    )


def _measures(by_source: DataFrame, alpha: float, total: int) -> tuple[float, float]:
    """Entropy in nats of the weights at ``alpha``; the most passes over a source if none is cut short."""
    p = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))
    z, plogp, ratio = by_source.agg(F.sum(p), F.sum(p * F.log(p)), F.max(p / F.col("tokens")) / F.min(p / F.col("tokens"))).first()
    return math.log(z) - plogp / z, ratio


def exponent(by_source: DataFrame, entropy: float | None = None, repeat: float | None = None) -> float:
    """Bisects the exponent: ``entropy`` is a share of the log of the number of sources, ``repeat`` the most passes."""
    total, n = by_source.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n or n == 1:
        return 1.0
    if (entropy is None) == (repeat is None):
        raise ValueError("give a target entropy or a repetition limit")
    if entropy is not None:
        flat_enough = lambda k: _measures(by_source, k / GRID, total)[0] >= entropy * math.log(n) - 1e-9
        low, high = 0, GRID + 1  # the largest k that is flat enough
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if flat_enough(mid) else (low, mid)
        return low / GRID
    within = lambda k: _measures(by_source, k / GRID, total)[1] <= repeat + 1e-9
    low, high = -1, GRID  # the smallest k within the limit; at 1 every source has one pass
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if within(mid) else (mid, high)
    return high / GRID


def targets(by_source: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """``source, tokens, documents, weight, budget``; without a budget the scarcest need is one full pass.

    The default budget is the least at which every document appears once at least.
    """
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    p = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(alpha))
    powered = by_source.withColumn("__p", p)
    z, need = powered.agg(F.sum("__p"), F.max(F.col("tokens") / F.col("__p"))).first()
    all_tokens = float(budget) if budget is not None else (z or 0.0) * (need or 0.0)
    weight = F.col("__p") / F.lit(z or 1.0)
    share = F.floor(weight * F.lit(all_tokens) + 1e-6).cast("long")
    # rounding grows with the tokens and must not take the last document of the source that sets the budget
    return powered.select("source", "tokens", "documents", weight.alias("weight"), (share if budget is not None else F.greatest("tokens", share)).alias("budget"))


def _order(seed: int, *what: Column) -> Column:
    """A number below 2**60 that permutes what it is given; the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[w.cast("string") for w in what]).cast("binary")), 1, 15), 16, 10).cast("long")


def _block_order(number: Column) -> Column:
    """The place of ``block`` in the permutation of a pass."""
    return _order(1, number, F.col("source"), F.col("block"))


def _cuts(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``plan`` with ``passes`` and where each source's last pass ends: ``cut_order, cut_block, cut_place, cut_row``.

    Found from coarse to fine: among 1024 ranges of the block order, then the blocks of one range,
    then the documents of one block, so no window holds more of a source than that.
    """
    plan = plan.withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("left", F.col("budget") % F.col("tokens"))
    keyed = _with_plan(rows, plan, most)
    left = F.col("left")
    for level, keys in (("range", ["range"]), ("block", ["block_order", "block"]), ("document", ["place", "row"])):
        sums = keyed.groupBy("source", *keys).agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left"))
        upto = F.sum("t").over(W.partitionBy("source").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto)
        if level == "document":
            last = F.max(F.when(F.col("upto") <= left, F.struct(*keys))).alias("d")
            ends = sums.groupBy("source").agg(last).select("source", F.col("d.place").alias("cut_place"), F.col("d.row").alias("cut_row"))
            plan = plan.join(ends, "source", "left")
        else:
            # the one range or block with the end inside
            ends = sums.where((F.col("upto") - F.col("t") <= left) & (F.col("upto") > left))
            ends = ends.select("source", *[F.col(k).alias(f"cut_{k.removeprefix('block_')}") for k in keys], (F.col("upto") - F.col("t")).alias("__used"))
            plan = plan.join(ends, "source", "left").withColumn("left", F.col("left") - F.coalesce("__used", F.lit(0))).drop("__used")
            plan = checkpointed(plan)
            keyed = _with_plan(rows, plan, most)
            keyed = keyed.where("range = cut_range") if level == "range" else keyed.where("block = cut_block")
    return checkpointed(plan)


def _with_plan(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``rows`` with their source's plan and place in it; up to ``most`` sources are broadcast, more are looked up by a shuffle."""
    plan = plan.drop("tokens", "weight", "budget")
    n, total = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("documents"), F.lit(0))).first()
    if n <= most:
        found = rows.join(F.broadcast(plan), "source", "left")
    else:
        found = lookup(rows, plan, "source", "documents", total, F.col("place"))
    found = found.withColumn("block", F.pmod("place", F.col("blocks")))
    found = found.withColumn("block_order", _block_order(F.col("passes") + 1))
    return found.withColumn("range", F.shiftright("block_order", 50))


def realise(
    docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
    block_docs: int = 256, most_sources: int = 10_000,
) -> DataFrame:
    """A row for each time the mixture takes a row of ``docs``, with ``__source, __tokens, __pass, __block, __block_order, __place``.

    ``__pass`` counts from 1; in a pass over a source, rows come in the order of ``__block_order``, ``__block``, ``__place``.  A source of
    n documents has about n / ``block_docs`` blocks.  The last pass over a source ends before the document that would exceed
    its budget.  With up to ``most_sources`` sources the text is not shuffled; with more, the rows of sources that are not hot are.
    """
    blocks = plan.withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("documents") / block_docs)).cast("long"))
    place = _order(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    key = [F.coalesce(source_col, F.lit("")).alias("source"), n_tokens(F.col(text_col)).alias("n_tokens"), place.alias("place"), F.xxhash64(id_col, text_col).alias("row")]
    narrow = checkpointed(docs.select(*key))
    cut = _cuts(narrow, blocks, most_sources)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key)
    found = _with_plan(rows, cut, most_sources)
    before = F.struct("block_order", "block") < F.struct(F.col("cut_order"), F.col("cut_block"))
    inside = (F.col("block") == F.col("cut_block")) & (F.struct("place", "row") <= F.struct(F.col("cut_place"), F.col("cut_row"))) & F.col("cut_place").isNotNull()
    more = F.when(F.col("cut_block").isNotNull() & (before | inside), 1).otherwise(0)
    copies = F.col("passes") + more
    passes = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
    taken = found.withColumn("__pass", F.explode(passes))
    return taken.select(
        *[F.col(f"doc.`{c}`") for c in docs.columns], F.col("source").alias("__source"), F.col("n_tokens").alias("__tokens"), "__pass",
        F.col("block").alias("__block"), _block_order(F.col("__pass")).alias("__block_order"), F.col("place").alias("__place"),
    )


def in_order(taken: DataFrame, parts: int) -> DataFrame:
    """What ``realise`` took in ``parts`` ordered partitions, pass by pass; within a pass the blocks of all sources are mixed."""
    by = ["__pass", "__block_order", "__source", "__block", "__place"]
    return taken.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def planned(docs: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: int | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, tokens, documents, weight, budget`` of the mixture of ``docs``."""
    stats = checkpointed(shares(docs, source_col, text_col))
    return checkpointed(targets(stats, exponent(stats, entropy, repeat), budget))


def mix(
    docs: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", seed: int = 7,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, all columns."""
    plan = planned(docs, entropy, repeat, budget, source_col, text_col)
    return realise(docs, plan, id_col, text_col, source_col, seed).select(*[F.col(f"`{c}`") for c in docs.columns])
