"""Connected components of an edge table by alternating star contraction.

Each round points every node's larger neighbours at its smallest one, then its
smaller ones; rounds grow with the logarithm of the longest chain. Tables of a
round are written to the shared folder, so lineage stays short and a lost executor
repeats one round at most. A node with very many edges is one side of a join on
the other end's key with one row per node, which adaptive skew joins split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.llm.common import write_scratch


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node's neighbours and itself, from rows (u, v)."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of rows (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    out = both.join(_least(both), "u")
    if large:
        return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        out.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root its smallest reachable node."""
    edges = write_scratch(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                          .where("u > v").distinct(), "links")
    before = _mark(edges)
    while before[0]:
        edges = write_scratch(_star(write_scratch(_star(edges, True), "large-star"), False), "small-star")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
