"""Connected components of an undirected graph given as edges, by rounds of large-star and small-star steps.

Each step links nodes to the smallest node near them; the edges turn into stars around the smallest node of each component, in a number of
rounds that grows with the logarithm of the graph. Smallest neighbours are found by aggregation, which Spark sums before its shuffle, and
joined back; a round is written to the shared folder, so lineage stays short and a lost executor costs a part of a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import look_up
from shelfscope.session import stage


def _near(edges: DataFrame) -> DataFrame:
    """Per node u of ``edges``: m, the least of it and its neighbours, n, its edges, and smaller, how many of them lead to a smaller node."""
    near = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("smaller"))
    return stage(near.select("u", F.least("u", "m").alias("m"), "n", "smaller"))


def _least(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours; a node with very many edges is not one task's work."""
    return look_up(edges, near.select("u", "m", "n"), "u", "n")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, near: DataFrame) -> DataFrame:
    """``near`` is that of the edges both ways."""
    return _least(_both_ways(edges), near).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger to the smaller node."""
    met = _least(edges, _near(edges))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(met.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest node of its component for each node of ``edges`` (u, v), the smallest ones themselves left out.

    Nodes are numbers without nulls. Loops and repeated edges change nothing; no edges, no rows. The rounds end once every node has one edge
    to a smaller node, or edges to larger ones only: each component is then a star around its smallest node.
    """
    stars = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not (near := _near(_both_ways(stars))).where("smaller > 1 OR (smaller = 1 AND n > 1)").isEmpty():
        stars = stage(_small_star(stage(_large_star(stars, near))))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("least"))
