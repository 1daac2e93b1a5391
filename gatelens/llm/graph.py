"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """edges (a long, b long) -> (node long, root long), root the least node reachable.

    Only nodes that have an edge to another node and aren't roots are returned.
    Each round rewrites the edges as Parquet, so that lineage stays short; the
    number of rounds is logarithmic in the size of a component. It ends when all
    edges are stars: no parent is a child, and no node has two parents. Nothing
    but two flags a round go to the driver.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )
    while True:
        both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), tag)
        e = _pointed(both, both.where("v > u"), F.col("v"), F.least("u", "m"))
        e = materialize(e.distinct(), tag)
        child = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        e = materialize(_pointed(e, e, child, F.col("m")).where("u <> v").distinct(), tag)
        nested = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if nested.isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _pointed(all_edges: DataFrame, edges: DataFrame, child: Column, parent: Column) -> DataFrame:
    """edges (u, v) as (child, parent), where m is the least neighbour of u among all edges; hubs aren't shuffled."""
    least = all_edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_hot(edges, least, ["u"], "n", all_edges.count()).select(child.alias("u"), parent.alias("v"))
