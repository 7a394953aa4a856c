"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.workspace import staged


def components(links: DataFrame) -> DataFrame:
    """``vertex`` and ``root``, the least vertex of its component, for the vertices of ``links`` (a, b).

    Stars are merged in turns: larger neighbours of a vertex move to its least neighbour, then smaller ones and the
    vertex itself do. Both keep components and bring every vertex to its root in few rounds, however long
    the chains are; no vertex's neighbours are ever collected. Vertices may be of any ordered type.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.min("b").alias("low"))

    def large(edges: DataFrame) -> DataFrame:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).select(F.col("a").alias("of"), F.least("a", "low").alias("low"))
        moved = both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("of"))
        return moved.select(F.col("b").alias("a"), F.col("low").alias("b"))

    def small(edges: DataFrame) -> DataFrame:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = least(down)
        moved = down.join(low.select(F.col("a").alias("of"), "low"), F.col("a") == F.col("of"))
        return low.select("a", F.col("low").alias("b")).unionAll(
            moved.where(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")))

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)"))).first()

    edges = staged(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    before, now = None, state(edges)
    while before != now:
        edges = staged(small(large(edges)).distinct(), "stars")
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
