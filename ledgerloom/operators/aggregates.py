"""Revenue, product, pipeline and agent aggregates.

All are grouped or global aggregates with partial aggregation before the shuffle, so a hot key
costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import money, pace
from ledgerloom.schemas import FINE_MONEY, moment


def sum_if(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


# ledger


def is_sale() -> Column:
    return F.col("type") == "sale"


def is_expense() -> Column:
    return F.col("type") == "expense"


def totals(tx: DataFrame) -> DataFrame:
    """Revenue, expenses, net and number of sales in one pass; exact decimals."""
    return tx.agg(
        sum_if(is_sale(), F.col("net")).alias("revenue"),
        sum_if(is_expense(), F.abs("net")).alias("expenses"),
        F.coalesce(F.sum("net"), F.lit(0)).alias("net"),
        F.count(F.when(is_sale(), 1)).alias("sales"),
    )


def ledger_summary(tx: DataFrame, products: DataFrame) -> DataFrame:
    """The ledger's totals and the number of listed products, in one record."""
    listed = products.agg(F.count(F.when(F.col("status") == "listed", 1)).alias("listed"))
    return one_row(totals(tx), listed)


def sales_total(tx: DataFrame) -> DataFrame:
    """Sale revenue, count and average order value."""
    t = tx.where(is_sale()).agg(F.coalesce(F.sum("net"), F.lit(0)).alias("revenue"), F.count("*").alias("sales"))
    avg = F.when(F.col("sales") > 0, money.usd(F.col("revenue")) / F.col("sales")).otherwise(F.lit(0.0))
    return t.withColumn("avg_order", avg)


def product_rollup(products: DataFrame, tx: DataFrame) -> DataFrame:
    """Products with sales and revenue counted from the ledger."""
    per_product = (
        tx.where(is_sale() & F.col("product_id").isNotNull())
        .groupBy(F.col("product_id").alias("id"))
        .agg(F.count("*").alias("sales"), F.sum("net").cast(FINE_MONEY).alias("revenue"))
    )
    return products.drop("sales", "revenue").join(per_product, "id", "left").withColumns({
        "sales": F.coalesce("sales", F.lit(0)),
        "revenue": F.coalesce("revenue", F.lit(0).cast(FINE_MONEY)),
    })


def daily_metrics(tx: DataFrame, opportunities: DataFrame, products: DataFrame) -> DataFrame:
    """Money by day of the transaction, counts by day of creation, one row per day.

    What has no time is in the row without a date, so that the days add up to the totals.
    """
    facts = (
        tx.select(
            F.to_date("occurred_at").alias("date"),
            F.when(is_sale(), F.col("net")).alias("revenue"),
            F.when(is_expense(), F.abs("net")).alias("expenses"),
            "net",
            F.when(is_sale(), 1).alias("sales_count"),
        ),
        opportunities.select(F.to_date("created_at").alias("date"), F.lit(1).alias("opportunities_found")),
        products.select(
            F.to_date("created_at").alias("date"),
            F.lit(1).alias("products_created"),
            F.when(F.col("status") == "listed", 1).alias("products_listed"),
        ),
    )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    amounts = ("revenue", "expenses", "net")
    counts = ("opportunities_found", "products_created", "products_listed", "sales_count")
    return rows.groupBy("date").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast(FINE_MONEY).alias(c) for c in amounts],
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
    )


# opportunities and products


def opportunities_by(opportunities: DataFrame, *keys: str) -> DataFrame:
    """Number and average estimate of opportunities per key."""
    est = money.usd(F.sum("estimated_revenue")) / F.count("estimated_revenue")
    some = F.count("estimated_revenue") > 0
    return opportunities.groupBy(*keys).agg(F.count("*").alias("n"), F.when(some, est).alias("avg_est"))


def products_by_status(products: DataFrame) -> DataFrame:
    return products.groupBy("status").agg(F.count("*").alias("n"))


def product_gmv(products: DataFrame) -> DataFrame:
    """Number and total price of products per status."""
    return products.groupBy("status").agg(F.count("*").alias("n"), F.sum("price").alias("gmv"))


def catalog_counts(products: DataFrame) -> DataFrame:
    """Listed and draft counts and the price total of listed products, as columns."""
    listed = F.col("status") == "listed"
    return products.agg(
        F.count(F.when(listed, 1)).alias("total_listed"),
        F.count(F.when(F.col("status") == "draft", 1)).alias("total_draft"),
        sum_if(listed, F.col("price")).alias("potential_gmv"),
    )


def opportunity_counts(opportunities: DataFrame) -> DataFrame:
    """Open work (pending or in progress) and completed work (listed)."""
    status = F.col("status")
    return opportunities.agg(
        F.count(F.when(status.isin("pending", "in_progress"), 1)).alias("open"),
        F.count(F.when(status == "listed", 1)).alias("completed"),
    )


def opportunity_pipeline(opportunities: DataFrame) -> DataFrame:
    """One row: open and completed work, and ``by_status``, the number of opportunities in each status."""
    per_status = opportunities.groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"))
    return per_status.agg(
        F.coalesce(F.sum(F.when(F.col("status").isin("pending", "in_progress"), F.col("n"))), F.lit(0)).alias("open"),
        F.coalesce(F.sum(F.when(F.col("status") == "listed", F.col("n"))), F.lit(0)).alias("completed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"),
    )


def catalog(products: DataFrame, as_of: str) -> DataFrame:
    """``catalog_counts`` and ``days_running`` in one pass."""
    listed = F.col("status") == "listed"
    sums = products.agg(
        F.count(F.when(listed, 1)).alias("total_listed"),
        F.count(F.when(F.col("status") == "draft", 1)).alias("total_draft"),
        sum_if(listed, F.col("price")).alias("potential_gmv"),
        F.min("created_at").alias("first_created"),
    )
    days = pace.whole_days(F.col("first_created"), moment(as_of)) + 1
    return sums.withColumn("days_running", F.coalesce(days, F.lit(1)))


def days_running(products: DataFrame, as_of: str) -> DataFrame:
    """First creation time and the number of the current day, counting from 1."""
    first = products.agg(F.min("created_at").alias("first_created"))
    days = pace.whole_days(F.col("first_created"), moment(as_of)) + 1
    return first.withColumn("days_running", F.coalesce(days, F.lit(1)))


# store summaries


def marketplace_summary(paid_orders: DataFrame) -> DataFrame:
    """Paid orders with the integer fee taken per order; a loss shows as zero."""
    sums = paid_orders.agg(
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum("amount"), F.lit(0)).alias("gross_cents"),
        F.coalesce(F.sum(money.net_cents(F.col("amount"))), F.lit(0)).alias("net_cents"),
    )
    return sums.select(
        "total_orders",
        (F.col("gross_cents") / 100).alias("gross_revenue_usd"),
        F.greatest(F.lit(0.0), F.col("net_cents") / 100).alias("net_revenue_usd"),
    )


def store_summary(paid_orders: DataFrame) -> DataFrame:
    """Paid orders of the other store, which keeps a flat share."""
    sums = paid_orders.agg(F.count("*").alias("total_orders"), F.coalesce(F.sum("total"), F.lit(0)).alias("cents"))
    return sums.select(
        "total_orders",
        (F.col("cents") / 100).alias("gross_revenue_usd"),
        (money.usd(F.col("cents").cast("decimal(20,0)") * (100 - money.STORE_KEEPS_PERCENT)) / 10000)
        .alias("net_revenue_usd"),
    )


# agents


def agent_state(runs: DataFrame) -> DataFrame:
    """Latest state per agent, folded from the log of state writes.

    The newest row wins as a whole, so its NULL task replaces an older task.
    """
    written = [c for c in ("status", "current_task", "metadata") if c in runs.columns]
    latest = F.max(F.struct("run_at", "seq", *written))
    state = runs.groupBy("agent_id").agg(
        latest.alias("latest"),
        F.count("*").alias("run_count"),
        F.count(F.when(F.col("status") == "running", 1)).alias("runs_started"),
    )
    return state.select(
        "agent_id", F.col("latest.run_at").alias("last_run"), "run_count",
        *[f"latest.{c}" for c in written], "runs_started",
    )
