"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, removed, stored, tasks_for

#: Bytes of an edge in a task that writes edges.
EDGE_BYTES = 64


def _settled(edges: DataFrame, n: int) -> bool:
    """Whether every ``u`` has one ``v``, and no ``v`` is a ``u`` itself."""
    if edges.select("u").distinct().count() < n:
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _stars(edges: DataFrame, total: int, paths: list[str]) -> DataFrame:
    """Each edge ``u, v`` with ``m``, the smallest neighbour of ``u``, ``u`` included.  ``edges`` must be stored: it is read twice."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = _kept(least.withColumn("m", F.least("u", "m")), paths, total)
    return lookup(edges, least, "u", "n", total, F.col("v"))


def _kept(df: DataFrame, paths: list[str], most: int) -> DataFrame:
    """``df`` stored, in no more files than ``most`` rows are worth."""
    out, path = stored(df.coalesce(tasks_for(df.sparkSession, most * EDGE_BYTES)), "components")
    paths.append(path)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with an edge: ``root`` is the smallest node it can reach.

    Self-loops, repeated edges and nulls are ignored.  Every step is stored, so that plans stay small, until only stars are left;
    the tables of a round are deleted once the next is there.  Nodes with a thousandth of all edges are looked up by
    broadcast, so a star of any size stays spread out.
    """
    spark = edges.sparkSession
    e, path = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    while not _settled(e, n := e.count()):
        paths = [path]
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large = _stars(_kept(both, paths, 2 * n), 2 * n, paths).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(_kept(large, paths, 2 * n), n, paths)
        own, other = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        out = small.select(F.explode(F.when(F.col("v") != F.col("m"), F.array(own, other)).otherwise(F.array(own))).alias("e")).select("e.u", "e.v")
        done, paths = paths, []
        e = _kept(out.distinct(), paths, 2 * n)
        path = paths[0]
        removed(spark, done)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
