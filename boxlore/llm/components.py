"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxlore.llm.common import Workspace, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node of its component.

    Large-star and small-star steps by turns: each hangs the neighbours of a node on its
    smallest neighbour, so the number of rounds grows with the logarithm of the size of a
    component.  Only keys move, minima are formed before the shuffle, and each round is
    written, so that a lost executor costs one round at most; the tables of the round before go.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark, last = edges.sparkSession, Workspace(edges.sparkSession, "links")
    edges = last.written(edges, "edges")
    before = None
    while True:
        this = Workspace(spark, "stars")
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = this.written(large.where("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = this.written(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        last.drop()
        last = this
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = written(roots.union(roots.select("component", "component").distinct()), "components")
    last.drop()
    return found
