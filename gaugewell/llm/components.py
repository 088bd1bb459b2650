"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, join_totals


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the component's smallest node.

    A round hangs the larger neighbours of each node, then the smaller ones,
    on the smallest node seen; the number of rounds grows with the logarithm of
    the longest path.  Nodes with very many links are salted, links stay
    distributed, each round is checkpointed.  Null ends are ignored.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut_lineage(_near_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())
        hung = _near_least(large).select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
        edges = cut_lineage(hung.filter("a != b").distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _near_least(edges: DataFrame) -> DataFrame:
    """Links (a, b) with the least of a and all its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).withColumn("least", F.least("least", "a"))
    return join_totals(edges, least, ["a"], "n")
