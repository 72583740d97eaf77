"""Connected components by alternating large and small stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .work import Work


def components(links: DataFrame, work: Work, name: str, most: int = 60) -> DataFrame:
    """(node, root) of every node that has a link to another; root is the smallest node it is joined to.

    links has the columns a and b.  Each round is written out, so a lost executor costs one round; the
    minimum of a node's neighbours is summed up before the shuffle, so a node with very many links is
    not gathered anywhere.
    """
    edges = work.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0")
    for k in range(1, most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.withColumnRenamed("m", "v")).distinct()
        edges = work.table(small, f"{name}{k}")
        if k > 1:
            work.drop(f"{name}{k - 2}")
        # done when each node has one edge and no root has any: stars apart from each other
        ends = edges.groupBy("u").agg(F.count("*").alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("n")).distinct())
        if ends.groupBy("u").agg(F.max("n").alias("n"), F.count("*").alias("sides")).where("n > 1 or sides > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
