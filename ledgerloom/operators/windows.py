"""First-wins deduplication and mailbox positions, without a per-key window over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.sinks.tables import stage

# monotonically_increasing_id numbers the rows of a partition in the low 33 bits.
ROW_BITS = 33


def ranked(orders: DataFrame, key: str, order: tuple[str, ...]) -> Column:
    """All columns but ``key`` as a struct that sorts by ``order``, NULL last, then by the others."""
    rest = [c for c in orders.columns if c != key and c not in order]
    return F.struct(*[c for name in order for c in (F.col(name).isNull().alias(f"no_{name}"), F.col(name))], *rest)


def keep_first(orders: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """One row per key: the first by ``order``, NULL last, remaining columns breaking ties.

    A minimum over a struct is aggregated before the shuffle, so a key that fills a third of the
    rows is one partial row per task.
    """
    first = orders.groupBy(key).agg(F.min(ranked(orders, key, order)).alias("first"))
    return first.select(*[F.col(key) if c == key else F.col(f"first.{c}") for c in orders.columns])


ORDER_RANK = ("created_at", "amount", "customer_email", "status")


def first_orders(orders: DataFrame) -> DataFrame:
    """One row per order id. Orders without an id can't be told apart and are left to ``rejected_orders``."""
    return keep_first(orders.where(F.col("id").isNotNull()), "id", ORDER_RANK)


def rejected_orders(orders: DataFrame) -> DataFrame:
    """The orders that no sync can take, as they have no id."""
    return orders.where(F.col("id").isNull())


def drain_positions(messages: DataFrame, folder: str) -> DataFrame:
    """Unread messages numbered by age within their recipient's mailbox.

    A mailbox can hold any share of the messages, so rows are range-partitioned by
    (recipient, time, id), which splits a large mailbox over many tasks. Each row is numbered in
    its partition, and the counts of earlier partitions of the same mailbox are added.

    The numbered rows are written once to ``folder``, as a second, differently sampled range
    partitioning would give other numbers. The counts, one row per mailbox and partition, are
    written too: Spark then knows their size and broadcasts them only if they are small.
    """
    order = ["to_agent", "created_at", "id"]
    numbered = (
        messages.where(F.col("read") == 0)
        .select("id", "to_agent", "from_agent", "type", "created_at")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("slot", F.monotonically_increasing_id())
    )
    rows = stage(numbered, f"{folder}/rows").withColumn("part", F.shiftright("slot", ROW_BITS))
    spans = rows.groupBy("to_agent", "part").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n"))
    earlier = F.sum("n").over(
        Window.partitionBy("to_agent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = stage(spans.select(
        F.col("to_agent").alias("box"), F.col("part").alias("box_part"), "first_slot",
        F.coalesce(earlier, F.lit(0)).alias("earlier"),
    ), f"{folder}/starts")
    same = F.col("to_agent").eqNullSafe(F.col("box")) & (F.col("part") == F.col("box_part"))
    return rows.join(starts, same).select(
        "id", "to_agent", "from_agent", "type", "created_at",
        (F.col("slot") - F.col("first_slot") + F.col("earlier") + 1).alias("position"),
    )
