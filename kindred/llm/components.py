"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import joined_apart, written


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (a > b) is a leaf with one edge or the end of others' edges alone."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf")))
    other = ends.groupBy("node").agg(F.sum("leaf").alias("edges"), F.min("leaf").alias("least")).where("edges > 1 OR edges = 1 AND least = 0")
    return other.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) for every node of the edges (a, b: long).

    Each round points every node at the smallest of its neighbours, first for the larger ones,
    then for the smaller, until the edges are stars; if they are from the start, there is no round.
    A round is two joins on the node, which adaptive execution splits where a node has very many
    edges; its result is a written table.
    Edges with a null end, or from a node to itself, say nothing; a node that has no others is not
    in the result. No edges give no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = joined_apart(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = joined_apart(large, low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
