"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each level reads more of a text than the one before and only for rows whose group was still
larger than one: the length, the first ``prefix`` characters, the whole.  What survives a level is passed on
as a bit filter sized by the keys that survive, so no text is shuffled in order to decide; the last level
compares SHA-256 digests in a narrow table.  ``deduplicate`` shuffles no text either, but for the few rows
that two filters mistake for losers.

Defined cases: a null text counts as empty; texts are equal if identical after lower-casing A-Z
only.  Of equal texts the row with the largest id stays; a null id is smaller than any other.
Rows that repeat both id and text are one document: all are marked as kept by ``verdicts``, and
``deduplicate`` returns one of them.  Long texts are hashed whole where they lie.  Empty tables give
empty results; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitset, checkpointed, filter_bits, flag, identity, lookup, lower_ascii, shielded, single, without


def _length(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _head(text: str, prefix: int) -> Column:
    """A hash of the length and the normalised prefix; only that much of the text is normalised."""
    return F.xxhash64(_length(text), lower_ascii(F.substring(text, 1, prefix)))


def _refined(docs: DataFrame, text: str, prefix: int) -> DataFrame:
    """``docs`` with ``__digest``: of the whole text for rows that may have an equal, else null."""
    narrow = checkpointed(docs.select(_length(text).alias("length"), _head(text, prefix).alias("head")))
    lengths = checkpointed(narrow.groupBy("length").count().where("count > 1"))
    bits = filter_bits(lengths.count())
    by_length = checkpointed(bitset(lengths, "length", bits))
    level1 = flag(narrow, by_length, F.col("length"), bits, "__l1").where("__l1")

    heads = checkpointed(level1.groupBy("head").count().where("count > 1"))
    bits = filter_bits(heads.count())
    by_head = checkpointed(bitset(heads, "head", bits))
    level2 = flag(docs, by_head, _head(text, prefix), bits, "__l2")
    return level2.withColumn("__digest", F.when(F.col("__l2"), F.sha2(lower_ascii(F.col(text)), 256))).drop("__l2")


def _groups(narrow: DataFrame, id_col: str) -> DataFrame:
    """``__digest, keep_id, group_size, again`` of texts that occur more than once; ``again`` is how often the row that stays does."""
    ids = narrow.where("__digest is not null").groupBy("__digest", F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("c"))
    # a struct orders a null id first
    last = F.max(F.struct("__id", "c"))
    found = ids.groupBy("__digest").agg(last.alias("last"), F.sum("c").alias("group_size")).where("group_size > 1")
    return checkpointed(found.select("__digest", F.col("last.__id").alias("keep_id"), "group_size", F.col("last.c").alias("again")))


def _rows(groups: DataFrame) -> int:
    return groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[Column] = (), prefix: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, and the ``carry`` expressions.

    ``prefix`` is the number of characters the second level hashes.  ``carry`` is evaluated beside
    the scan, so that a digest of the text can travel instead of the text.
    """
    refined = _refined(docs, text_col, prefix)
    rows = checkpointed(refined.select(F.col(id_col).alias("__id"), "__digest", *[c.alias(f"__carry{i}") for i, c in enumerate(carry)]))
    groups = _groups(rows, "__id").drop("again")
    found = lookup(rows, groups, "__digest", "group_size", _rows(groups), F.col("__id"))
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    names = docs.select(*carry).columns if carry else []
    return found.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        *[F.col(f"__carry{i}").alias(name) for i, name in enumerate(names)],
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return shielded(docs, [id_col, text_col], lambda docs, id_col, text_col: _deduplicated(docs, id_col, text_col, prefix))


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    refined = _refined(docs, text_col, prefix)
    narrow = checkpointed(refined.where("__digest is not null").select(F.col(id_col).alias("__id"), "__digest", identity(id_col, F.col("__digest")).alias("__key")))
    groups = _groups(narrow, "__id")
    verdict = lookup(narrow, groups, "__digest", "group_size", _rows(groups), F.col("__id")).where("group_size is not null")
    stays = F.col("__id").eqNullSafe(F.col("keep_id"))
    verdict = checkpointed(verdict.select("__key", stays.alias("stays"), (stays & (F.col("again") > 1)).alias("again")))
    rows = refined.withColumn("__key", identity(id_col, F.col("__digest")))
    rows = without(rows, verdict.where("not stays"), "__key", narrow)
    return single(rows, verdict.where("again"), "__key").select(*docs.columns)
