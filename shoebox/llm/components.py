"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import work_path, written


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or its smaller) neighbours to the least of it and its neighbours."""
    spark = edges.sparkSession
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = written(least, work_path(spark, "least"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return written(out.where("u != v").distinct(), work_path(spark, "star"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(u, v), two longs; root is the least node of its component.

    The number of rounds grows with the logarithm of a component's width. Each round is a table in
    the shared folder; a hub's links are aggregated before they move and its rows are split when
    they are joined. Loops and repeated links are allowed; no links give no rows.
    """
    spark = links.sparkSession
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), work_path(spark, "links"))
    before = _print(edges)
    while before[0]:
        edges = _star(_star(edges, large=True), large=False)
        now = _print(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
