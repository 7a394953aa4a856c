"""Ranked and newest-first lists. Every order ends in ``id`` so that a limit keeps the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import text
from ledgerloom.operators.filters import earning, insights_in
from ledgerloom.schemas import moment


def largest(column: str) -> tuple[Column, Column]:
    return F.desc_nulls_last(column), F.asc("id")


def top_pending(opportunities: DataFrame, k: int = 5) -> DataFrame:
    return opportunities.where(F.col("status") == "pending").orderBy(*largest("estimated_revenue")).limit(k)


def by_revenue(rollup: DataFrame) -> DataFrame:
    return earning(rollup).orderBy(*largest("revenue"))


def top_earners(rollup: DataFrame, k: int = 5) -> DataFrame:
    return by_revenue(rollup).limit(k)


def recent_transactions(tx: DataFrame, k: int = 20) -> DataFrame:
    return tx.orderBy(F.desc_nulls_last("occurred_at"), "id", "transaction_id").limit(k)


def newest(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(*largest("created_at")).limit(k)


def recent_opportunities(opportunities: DataFrame, k: int = 20) -> DataFrame:
    return newest(opportunities, k).select("title", "type", "status")


def recent_products(products: DataFrame, k: int = 10) -> DataFrame:
    return newest(products, k).select(
        "id", "title", "price", "status", "platform", "platform_url", "created_at"
    )


def recent_insights(insights: DataFrame, k: int = 8) -> DataFrame:
    chosen = insights_in(insights, "alert", "recommendation", "trend")
    return newest(chosen, k).select("id", "category", "title", "score", "created_at")


def topic_insights(insights: DataFrame, k: int = 10) -> DataFrame:
    """Best scored trends and niches."""
    chosen = insights_in(insights, "trend", "niche")
    return chosen.orderBy(F.desc_nulls_last("score"), *largest("created_at")).limit(k).select(
        "id", "title", "data", "score", "created_at"
    )


def activity(messages: DataFrame, k: int = 12) -> DataFrame:
    return newest(messages, k).select("id", "from_agent", "to_agent", "type", "payload", "created_at")


def newest_days(daily: DataFrame, k: int = 14) -> DataFrame:
    return daily.orderBy(F.desc_nulls_last("date")).limit(k).select(
        "date", "revenue", "products_created", "products_listed", "sales_count"
    )


def bar_days(daily: DataFrame, k: int = 7) -> DataFrame:
    """The newest ``k`` days, oldest first, labelled for a bar chart."""
    days = newest_days(daily, k).orderBy("date")
    return days.select("date", "products_created", text.day_label(F.col("date")).alias("label"))


def activity_lines(messages: DataFrame, as_of: str) -> DataFrame:
    """Display fields of mailbox activity."""
    payload = F.col("payload")
    task = F.coalesce(
        text.not_empty(text.payload_field(payload, "task")), text.payload_field(payload, "title"), F.lit("")
    )
    return messages.select(
        "id", "from_agent", F.coalesce(text.not_empty(F.col("to_agent")), F.lit("broadcast")).alias("recipient"),
        "type", text.cut(task, 40).alias("subject"), text.fmt_age(F.col("created_at"), moment(as_of)).alias("age"),
    )


def ranked_text(ranked: DataFrame, rank: list[Column], line: Column, header: str) -> DataFrame:
    """One text of the lines of an already limited frame, in rank order; empty when it has no rows."""
    lines = F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)], line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda r: r["line"]), "\n")
    return ranked.agg(F.when(F.count("*") > 0, F.concat(F.lit(header), body)).otherwise(F.lit("")).alias("context"))


def topic_context(insights: DataFrame, k: int = 10) -> DataFrame:
    """The best topics as a bulleted text for a writer."""
    rank = [F.col("score").isNull(), -F.col("score"), -F.unix_micros("created_at"), F.col("id")]
    # Fixed value: the heading of the list.
    header = "\n\nMarket insights to consider:\n"
    return ranked_text(topic_insights(insights, k), rank, F.concat(F.lit("- "), F.col("title")), header)
