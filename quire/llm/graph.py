"""Connected components of an edge table by alternating stars: rounds of grouped minima and joins, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi")
    return not several.union(chained).limit(1).count()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(u, v), long -> (node, label): the smallest node that each node reaches. Nodes without an edge are not listed.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least of them, and ends when
    all edges are stars. Minima are written to the shared folder before edges are joined with them: both sides
    of a join are then plain tables, and the partition of a node with very many edges can be split.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _are_stars(now):
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
