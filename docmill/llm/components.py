"""Connected components of a link table, by alternating large and small stars.

Every round is two joins and aggregations over the links and is written to the shared folder, so
a lost executor costs one round at most.  The links of a component shrink towards a star around
its smallest node; the rounds end when nothing moves, after about the logarithm of the largest
component's size.  A node's neighbours are never gathered, only their minimum is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.shared import drop, written


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (u, v); the label is the smallest node of its component.  No links give no rows."""
    spark = links.sparkSession
    paths: list[str] = []

    def step(df: DataFrame) -> DataFrame:
        out, path = written(df.where("u <> v").distinct(), "links")
        paths.append(path)
        return out

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = step(links.select("u", "v"))
    before, after = None, state(now)
    while before != after:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = step(both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _minima(down)
        now = step(down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        before, after = after, state(now)
        for path in paths[:-1]:
            drop(spark, path)
        del paths[:-1]
    nodes = now.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.select(F.col("u").alias("node"), "label").unionByName(nodes.select(F.col("label").alias("node"), "label").distinct())
