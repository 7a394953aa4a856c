"""Equi-joins between the tables.

A side with a hot key must meet a side that is unique by that key. Where the hot side is kept whole
(lookups, orders against the ledger), both sides enter the join straight from their shuffle, which
lets adaptive execution split the hot partition. Where the hot side only tests for existence, it is
reduced to its distinct keys, before the shuffle already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.text import not_empty
from ledgerloom.operators.feeds import largest
from ledgerloom.operators.filters import creation_tasks, listed
from ledgerloom.workspace import staged


def distinct_keys(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def product_opportunity(rollup: DataFrame, opportunities: DataFrame) -> DataFrame:
    """All products, best earners first, with the type and effort of their opportunity."""
    o = opportunities.select(F.col("id").alias("opportunity_id"), F.col("type").alias("opp_type"), "effort_hours")
    return (
        rollup.select(
            "id", "opportunity_id", "title", "price", "sales", "revenue", "status", "platform", "created_at"
        )
        .join(o, "opportunity_id", "left")
        .orderBy(*largest("revenue"))
    )


def draft_queue(products: DataFrame, opportunities: DataFrame, k: int = 10) -> DataFrame:
    """The oldest drafts that belong to an opportunity."""
    o = opportunities.select(
        F.col("id").alias("opportunity_id"), F.col("type").alias("opp_type"), F.col("description").alias("opp_desc")
    )
    drafts = products.where(F.col("status") == "draft")
    return (
        drafts.join(o, "opportunity_id")
        .orderBy("created_at", "id")
        .limit(k)
        .select("id", "title", "description", "price", "file_path", "opp_type", "opp_desc", "created_at")
    )


def requested_opportunities(messages: DataFrame, opportunities: DataFrame) -> DataFrame:
    """The pending opportunity named by each creation task."""
    pending = opportunities.where(F.col("status") == "pending").select(
        F.col("id").alias("opportunity_id"), "title", F.col("type").alias("opp_type"), "estimated_revenue"
    )
    tasks = creation_tasks(messages).select(F.col("id").alias("message_id"), "opportunity_id")
    return tasks.join(pending, "opportunity_id")


def listed_parents(opportunities: DataFrame, products: DataFrame) -> DataFrame:
    """Opportunities that have a listed product."""
    return opportunities.join(distinct_keys(listed(products), "opportunity_id", "id"), "id", "left_semi")


def not_in_ledger(orders: DataFrame, ledger: DataFrame) -> DataFrame:
    """Orders whose id is no transaction id of the ledger yet; the ledger has an order once.

    An order without an id can't be looked up and is not among them.
    """
    known = ledger.select(F.col("transaction_id").alias("id")).where(F.col("id").isNotNull())
    return orders.where(F.col("id").isNotNull()).join(known, "id", "left_anti")


def not_in_buckets(orders: DataFrame, ledger: DataFrame) -> DataFrame:
    """``not_in_ledger`` for a ledger in buckets of its key, which is not shuffled, and orders of which one id may have many.

    The ids are looked up once each and what the ledger has of them is written; the orders, written too so that payloads are
    parsed once, then meet a side that comes from a shuffle or is small, so a hot id is split.
    """
    given = staged(orders.where(F.col("id").isNotNull()), "orders")
    known = ledger.select(F.col("transaction_id").alias("id"))
    hit = staged(distinct_keys(given, "id", "id").join(known, "id", "left_semi"), "known-ids")
    return given.join(hit, "id", "left_anti")


def new_keys(batch: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch``, one per ``key``, whose key ``history`` does not have.

    ``batch`` is a stored table, so Spark knows its size. The keys of the history, by far the larger
    side, are first narrowed to those of the batch: by a broadcast if the batch is small, so that the
    history is scanned and not shuffled, and by a shuffle join otherwise.
    """
    known = history.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(known, key, "left_anti").select(*batch.columns)


def new_titles(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found opportunities of unknown title, the lowest id per title; those without an id come last."""
    columns = [c for c in found.columns if c not in ("id", "title")]
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", *columns)
    first = found.groupBy("title").agg(F.min(rank).alias("first"))
    fresh = first.join(distinct_keys(known, "title", "title"), "title", "left_anti")
    return fresh.select("title", "first.*").drop("no_id")


def with_file(requests: DataFrame, products: DataFrame) -> DataFrame:
    """The file a request names, else the one stored with the product."""
    stored = products.select(F.col("id").alias("product_id"), F.col("file_path").alias("stored_path"))
    path = F.coalesce(not_empty(F.col("file_path")), F.col("stored_path"))
    return requests.join(stored, "product_id", "left").withColumn("file_path", path).drop("stored_path")
