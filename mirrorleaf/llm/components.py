"""Connected components of a graph in a table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.session import remove_folder, store_table


def _smaller_first(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _smaller_first(moved)


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _smaller_first(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node with an edge down has one, to a node that has none."""
    down = edges.groupBy("a").agg(F.count("*").alias("n"))
    return down.where("n > 1").isEmpty() and edges.join(down.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the least node it is linked to.

    Large-star and small-star steps alternate until each component is a star around its
    least node; each round is a written table, and the one before it is deleted. Loops
    are ignored; a node without an edge to another has no row.
    """
    spark = edges.sparkSession
    edges, folder = store_table(spark, _smaller_first(edges), "edges")
    while not _is_forest_of_stars(edges):
        edges, next_folder = store_table(spark, _small_star(_large_star(edges)), "edges")
        remove_folder(spark, folder)
        folder = next_folder
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
