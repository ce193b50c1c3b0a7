"""Parent codes: the longest prefix one level up, or the nearest code with trailing zeros.

Both look a code's candidates up with an equi-join inside its own edition.  Parents are found once per
distinct code, so repeated codes neither multiply rows nor get different parents.

Candidates are several rows a code, made after the shuffle by whose size Spark would choose a broadcast: the joins say
that they are to be merged, so that nothing that grows with the edition is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ["system", "version"]


def parent_by_prefix(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """``df`` with ``parent_code``: the longest proper prefix that is a code of the level just above, else null.

    ``levels`` lists the levels from the top.  Only the level directly above counts: if it has no match, a
    level further up is not tried.
    """
    depth = F.create_map(*[F.lit(x) for i, lv in enumerate(levels) for x in (lv, i)])[F.col("level")]
    codes = df.select(*SCOPE, "level", "code").distinct().withColumn("depth", depth)
    above = codes.select(*SCOPE, "depth", F.col("code").alias("prefix")).where("depth is not null")
    # a row an edition and level: only prefixes as long as some code of the level above can be one
    lengths = above.groupBy(*SCOPE, "depth").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    long_enough = codes.where((F.col("depth") > 0) & (F.length("code") > 1)).withColumn("depth", F.col("depth") - 1)
    shorter = F.filter("lengths", lambda k: (k > 0) & (k < F.length("code")))
    prefixes = long_enough.join(F.broadcast(lengths), [*SCOPE, "depth"]).select(
        *SCOPE, "level", "code", "depth", F.explode(F.transform(shorter, lambda k: F.col("code").substr(F.lit(1), k))).alias("prefix")
    )
    found = prefixes.join(above.hint("merge"), [*SCOPE, "depth", "prefix"]).groupBy(*SCOPE, "level", "code").agg(F.max_by("prefix", F.length("prefix")).alias("parent_code"))
    return df.drop("parent_code").join(found.hint("merge"), [*SCOPE, "level", "code"], "left").select(*_order(df))


def parent_by_zero_suffix(df: DataFrame) -> DataFrame:
    """``df`` with ``parent_code``: with the fewest last characters set to zero, another existing code of the edition, else null."""
    codes = df.select(*SCOPE, "code").distinct()
    n = F.length("code")
    tried = codes.where(n > 1).select(*SCOPE, "code", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    tried = tried.withColumn("other", F.concat(F.col("code").substr(F.lit(1), n - F.col("k")), F.repeat(F.lit("0"), F.col("k")))).where("other <> code")
    known = codes.withColumnRenamed("code", "other")
    found = tried.join(known.hint("merge"), [*SCOPE, "other"]).groupBy(*SCOPE, "code").agg(F.min_by("other", "k").alias("parent_code"))
    return df.drop("parent_code").join(found.hint("merge"), [*SCOPE, "code"], "left").select(*_order(df))


def _order(df: DataFrame) -> list[str]:
    return df.columns if "parent_code" in df.columns else [*df.columns, "parent_code"]


def ancestors(df: DataFrame, code: str, most: int = 16) -> DataFrame:
    """The path from an entry to its top: ``step, code, label, level``; one equi-join a step (an extension)."""
    here = df.where(F.col("code") == code).limit(1).select(F.lit(0).alias("step"), "code", "label", "level", "parent_code")
    path = here
    for i in range(1, most):
        up = here.select(F.col("parent_code").alias("code")).where("code is not null")
        here = df.join(F.broadcast(up), "code").limit(1).select(F.lit(i).alias("step"), "code", "label", "level", "parent_code")
        path = path.unionByName(here)
        if here.isEmpty():
            break
    return path.drop("parent_code")
