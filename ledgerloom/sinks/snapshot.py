"""The data of the dashboard as one nested record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import money, pace
from ledgerloom.operators import aggregates, feeds


def rows_as_list(limited: DataFrame, name: str, rank: list[Column], *fields: str) -> DataFrame:
    """An already limited frame as one ordered array of structs."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(rank)]
    ranked = F.array_sort(F.collect_list(F.struct(*keys, F.struct(*fields).alias("row"))))
    return limited.agg(F.transform(ranked, lambda r: r["row"]).alias(name))


def snapshot(
    tx: DataFrame, products: DataFrame, opportunities: DataFrame, insights: DataFrame, messages: DataFrame,
    daily: DataFrame, agents: DataFrame, goal: float, as_of: str,
) -> DataFrame:
    """One row: the figures and the lists of the dashboard.

    Lists come from limited feeds. All agents that keep a state are in it, one entry each: agents are programs, and
    their table has a row for each.
    """
    newest_first = [-F.unix_micros("created_at"), F.col("id")]
    parts = aggregates.one_row(
        aggregates.sales_total(tx).select("revenue", "sales"),
        aggregates.catalog(products, as_of).drop("first_created"),
        aggregates.opportunity_pipeline(opportunities),
        rows_as_list(agents, "agents", [F.col("agent_id")],
                     "agent_id", "last_run", "run_count", "status", "current_task"),
        rows_as_list(feeds.recent_products(products), "recent_products", newest_first,
                     "title", "price", "status", "platform", "platform_url", "created_at"),
        rows_as_list(feeds.recent_insights(insights), "recent_insights", newest_first,
                     "category", "title", "score", "created_at"),
        rows_as_list(feeds.activity(messages), "activity", newest_first,
                     "from_agent", "to_agent", "type", "payload", "created_at"),
        rows_as_list(feeds.newest_days(daily), "daily", [-F.unix_date("date")],
                     "date", "revenue", "products_created", "products_listed", "sales_count"),
    )
    revenue = money.usd(F.col("revenue"))
    return parts.select(
        revenue.alias("revenue"), "sales", F.lit(float(goal)).alias("goal"),
        pace.shown_percent(revenue, goal).alias("pct"),
        pace.monthly_run_rate(revenue, F.col("days_running")).alias("run_rate"),
        "days_running", "total_listed", "total_draft", money.usd(F.col("potential_gmv")).alias("potential_gmv"),
        F.col("open").alias("opp_open"), F.col("completed").alias("opp_completed"),
        F.col("by_status").alias("opp_by_status"),
        "agents", "recent_products", "recent_insights", "activity", "daily",
    )


def snapshot_json(snapshot_row: DataFrame) -> DataFrame:
    return snapshot_row.select(F.to_json(F.struct("*")).alias("body"))
