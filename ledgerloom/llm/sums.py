"""Running sums over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.workspace import staged


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with, for each of ``sums``, ``<name>_before``, the sum over all rows earlier in ``order``, and
    ``<name>_total``, the sum over all rows.

    The table is range-partitioned and written, so that the ranges stay as they are; the rows of a range are summed
    in its task, and only the totals of ranges, one row for each, are summed across them and broadcast.
    """
    ranged = df.withColumns(sums).repartitionByRange(*order).withColumn("own_part", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    every, earlier = Window.partitionBy(), Window.orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col("own_part").alias("in_part")).agg(*[F.sum(n).alias(n) for n in sums])
    parts = parts.select("in_part", *[
        c for n in sums for c in (
            F.sum(n).over(every).alias(f"{n}_total"), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_offset"))])
    inside = Window.partitionBy("own_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(parts), F.col("own_part") == F.col("in_part"))
    return joined.withColumns({
        f"{n}_before": F.col(f"{n}_offset") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums
    }).drop("in_part", "own_part", *sums, *[f"{n}_offset" for n in sums])
