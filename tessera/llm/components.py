"""Connected components of a link table by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.workspace import discard, settle


def _large(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node near it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; edges point down (a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b"))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) to (node, root): the smallest node reachable, for every node with a link.

    Every round is written to the shared folder in place of the one before; rounds grow with the logarithm of
    the number of nodes. ``_reads`` is the table behind the result. Joins on a node with many neighbours are split by adaptive execution.
    """
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tally = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
    before = tally(edges)
    while before[0]:
        last, edges = edges, settle(_small(_large(edges).filter("a <> b").distinct()).distinct(), "edges")
        discard(last)
        after = tally(edges)
        if after == before:
            break
        before = after
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._reads = edges
    return out
