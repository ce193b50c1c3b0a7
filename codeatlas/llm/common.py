"""Pieces several operators share: checkpoints, bounded filters and skew-safe lookups."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_arrow  # noqa: F401

#: A key with at least this share of all rows counts as hot: at most 1000 keys can.
HOT_SHARE = 1000
#: Bits of a membership filter: about 16 a key up to the most, which is 8 MB of bits and at most 2**20 rows to broadcast.
LEAST_BITS, MOST_BITS = 12, 26
#: What lower case may change beside A-Z: capitals, title case, and the number forms and symbols that have cases.
OTHER_CAPITALS = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"
#: Rows that a hot key adds to a lookup are broadcast only up to this many bytes each.
HOT_BYTES = 1 << 16
#: Bytes of a stored table that make a task, beyond two tasks a core.
TASK_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees.  Only where all tasks run on this machine may it be a local one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so later jobs read it and lost executors cost nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, size: int) -> int:
    """How many tasks a table of ``size`` bytes is worth."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def gathered(df: DataFrame) -> DataFrame:
    """``checkpointed(df)``, of which a task reads as many partitions as make ``TASK_BYTES``.

    A checkpoint has as many partitions as the shuffle before it, however few rows there are; each would be a task, and a file of every
    shuffle, in all steps that read it.
    """

    def width(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        return F.octet_length(c) if isinstance(kind, T.StringType | T.BinaryType) else 8 * F.size(c) if isinstance(kind, T.ArrayType) else F.lit(64 if isinstance(kind, T.StructType) else 16)

    seen = Observation()
    size = sum((F.coalesce(width(f), F.lit(0)) for f in df.schema), F.lit(0))
    kept = checkpointed(df.observe(seen, F.sum(size.cast("long")).alias("bytes")))
    return kept.coalesce(tasks_for(df.sparkSession, seen.get["bytes"] or 0))


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new path of the shared folder and read again, and the path.

    A checkpoint keeps the size that the plan before it was estimated at, which joins multiply: in a loop that number grows
    without bound and planning with it.  A table has the size of its files.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints of steps that nothing refers to any more.

    It does so when the driver collects its garbage, which one with memory to spare puts off for the whole of a long operator: between two
    large steps the disk then holds both.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty.

    Without any other capital in the text that is what ``lower`` does, several times as fast as ``translate``.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.length(t) == F.octet_length(t)
    return F.when(ascii_only | ~t.rlike(OTHER_CAPITALS), F.lower(t)).otherwise(F.translate(t, upper, upper.lower()))


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bitset(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A fixed-size membership filter over long keys: ``word, mask`` rows, at most ``2**(bits-6)`` of them.

    The size is bounded by ``bits`` whatever the number of keys, so it may be broadcast.
    It can report a key that is not there, never miss one that is.
    """
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
    )


def flag(rows: DataFrame, words: DataFrame, key: Column, bits: int, name: str) -> DataFrame:
    """``rows`` with boolean ``name``: whether ``key`` may be in the filter (null key: false)."""
    slot = F.pmod(key, F.lit(1 << bits))
    w = words.select(F.col("word").alias("__word"), F.col("mask").alias("__mask"))
    hit = F.getbit(F.coalesce("__mask", F.lit(0)), F.coalesce(slot.bitwiseAND(F.lit(63)), F.lit(0)).cast("int")) == 1
    return (
        rows.join(F.broadcast(w), F.shiftright(slot, 6) == F.col("__word"), "left")
        .withColumn(name, hit & key.isNotNull())
        .drop("__word", "__mask")
    )


def filter_bits(keys: int) -> int:
    """The size of a filter for so many keys; beyond the limit it lets more through, never less."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * keys).bit_length()))


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column, small: Column | None = None) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row per key) without a hot key meeting in one task.

    ``groups[size]`` is the number of rows of the key and ``total`` the sum over all keys; a
    key with a thousandth of them is hot, so at most 1000 keys are broadcast, and of these only such as
    are ``small``.  All other rows go through a shuffle on the key; hot rows are dealt by ``spread`` instead.
    Null keys find nothing.  Columns of ``groups`` other than the key are added.
    """
    added = [c for c in groups.columns if c != key]
    hot = F.col(size) * HOT_SHARE >= F.lit(total)
    hot = groups.where(hot if small is None else hot & small).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in added])
    named = lambda c: F.concat(F.lit("\x01"), F.col(c).cast("string"))
    cold = groups.select(named(key).alias("__cold"), *[F.col(c).alias(f"__cold_{c}") for c in added])
    aside = F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn(
        "__deal", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), aside).otherwise(named(key))
    )
    found = dealt.join(cold, F.col("__deal") == F.col("__cold"), "left")
    return found.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in added],
    )


def identity(id_col: str, digest: Column) -> Column:
    """A string that tells rows with different ids or different digests apart; a null digest gives null."""
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-")), F.lit("/"), digest)


def sha_of(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")).cast("binary"))


def _flagged(rows: DataFrame, keys: DataFrame, key: str, n: int, name: str) -> DataFrame:
    bits = filter_bits(n)
    words = gathered(bitset(keys.select(F.xxhash64(key).alias("h")), "h", bits))
    return flag(rows, words, F.when(F.col(key).isNotNull(), F.xxhash64(key)), bits, name)


def without(rows: DataFrame, losers: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` (a string, or null) is not in ``losers``.

    ``keys`` has the column ``key`` of all of ``rows``, kept from before.  A filter over the losers passes most rows on
    where they are; a second one over the keys that the first takes for losers by mistake drops most losers.
    Only rows that both flag are shuffled, to be compared exactly.
    """
    losers = gathered(losers.select(key).distinct())
    n = losers.count()
    if not n:
        return rows
    maybe = _flagged(keys.select(key), losers, key, n, "__maybe").where("__maybe").select(key).distinct()
    mistaken = gathered(maybe.join(losers, key, "left_anti"))
    both = _flagged(_flagged(rows, losers, key, n, "__maybe"), mistaken, key, mistaken.count(), "__again")
    rest = both.where("__maybe and __again").join(losers, key, "left_anti")
    return both.where("not __maybe").unionByName(rest.select(*both.columns)).drop("__maybe", "__again")


def single(rows: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """``rows``, one of each ``key`` that is in ``repeated``; the others stay where they are."""
    repeated = gathered(repeated.select(key).distinct())
    n = repeated.count()
    if not n:
        return rows
    both = _flagged(rows, repeated, key, n, "__maybe")
    # what is flagged by mistake occurs once, and stays as it is
    once = both.where("__maybe").dropDuplicates([key])
    return both.where("not __maybe").unionByName(once.select(*both.columns)).drop("__maybe")


def shielded(docs: DataFrame, used: list[str], operator: Callable[..., DataFrame]) -> DataFrame:
    """``operator(docs, *used)``, whose result has the columns of ``docs``, whatever these are called.

    Columns that could be taken for an operator's own (all of which begin with two underscores), that need quoting or that share a name
    go by their position meanwhile.
    """
    names = docs.columns
    plain = all(re.fullmatch(r"[A-Za-z0-9_]+", c) and not c.startswith("__") for c in names) and len({c.lower() for c in names}) == len(names)
    if plain:
        return operator(docs, *used)
    places = [names.index(u) for u in used]
    return operator(docs.toDF(*[f"column{i}" for i in range(len(names))]), *[f"column{i}" for i in places]).toDF(*names)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are ``keep_row`` in ``found``, one of those that repeat it."""
    found = gathered(found.select(F.col("row").alias("__row"), F.col("keep_row")))
    rows = docs.withColumn("__row", identity(id_col, sha_of(F.col(text_col))))
    again = found.where("__row = keep_row").groupBy("__row").count().where("count > 1")
    return single(without(rows, found.where("__row <> keep_row"), "__row", found), again, "__row").select(*docs.columns)


def numbered(rows: DataFrame, by: str, order: list[str], blocks: int, name: str) -> DataFrame:
    """``rows`` with ``name``: their number within ``by``, gapless from 0, whatever the size of a group.

    Rows are dealt to ``blocks`` blocks by a hash of ``order`` and numbered within; a block's numbers start after those of the
    blocks before it.  ``rows`` must be stored (it is read twice).
    """
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(max(1, blocks))))
    counts = dealt.groupBy(by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(by).orderBy("__block").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    counts = counts.select(by, "__block", before.alias("__before"))
    inner = F.row_number().over(W.partitionBy(by, "__block").orderBy(*order)) - 1
    found = dealt.withColumn("__inner", inner).join(counts, [by, "__block"])
    return found.select(*rows.columns, (F.col("__before") + F.col("__inner")).cast("long").alias(name))
