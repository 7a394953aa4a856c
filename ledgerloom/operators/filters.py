"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.schemas import DAY, moment


def mailbox_unread(messages: DataFrame, agent: str) -> DataFrame:
    """Unread messages for ``agent``, broadcasts included, oldest first, payload decoded."""
    mine = (F.col("to_agent") == agent) | F.col("to_agent").isNull()
    return (
        messages.where(mine & (F.col("read") == 0))
        .select("id", "from_agent", "type", F.from_json("payload", "map<string,string>").alias("payload"), "created_at")
        .orderBy("created_at", "id")
    )


def listed(products: DataFrame) -> DataFrame:
    return products.where(F.col("status") == "listed")


def catalog(products: DataFrame) -> DataFrame:
    return listed(products).select("title", "platform_url", "price", "description")


def insights_in(insights: DataFrame, *categories: str) -> DataFrame:
    return insights.where(F.col("category").isin(*categories))


def recent_transactions(tx: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Transactions strictly newer than ``days`` days before ``as_of``, newest first.

    Of a ledger kept by day, only the folders from that day on are read.
    """
    since = moment(as_of) - F.make_dt_interval(F.lit(days))
    if DAY in tx.columns:
        tx = tx.where((F.col(DAY) >= F.to_date(since)) | F.col(DAY).isNull())
    return tx.where(F.col("occurred_at") > since).orderBy(F.desc("occurred_at"), "id")


def paid_orders(orders: DataFrame, strict: bool = False) -> DataFrame:
    """Paid marketplace orders.

    The status is an enum name of varying spelling, so by default any text holding ``paid`` or
    ``succeeded`` counts, ``unpaid`` included; ``strict`` compares the last part exactly.
    """
    status = F.lower("status")
    if strict:
        return orders.where(F.element_at(F.split(status, r"\."), -1).isin("paid", "succeeded"))
    return orders.where(status.contains("paid") | status.contains("succeeded"))


def paid_store_orders(orders: DataFrame) -> DataFrame:
    return orders.where((F.col("status") == "paid") & ~F.col("refunded"))


def earning(products: DataFrame) -> DataFrame:
    return products.where(F.col("revenue") > 0)


def creation_tasks(messages: DataFrame) -> DataFrame:
    """Messages that ask for a product, with the opportunity they name; each payload is parsed once."""
    fields = F.inline(F.array(F.from_json("payload", "task string, opportunityId string")))
    tasks = messages.where(F.col("type") == "task").select("*", fields).where(F.col("task") == "create_product")
    named = tasks.withColumn("opportunity_id", F.col("opportunityId").try_cast("bigint"))
    return named.where(F.col("opportunity_id") != 0).drop("task", "opportunityId")


def has_email(email: Column) -> Column:
    return F.coalesce(email.contains("@"), F.lit(False))


def valid_leads(leads: DataFrame) -> DataFrame:
    """Leads that name a niche; an email is optional."""
    return leads.where(F.col("niche") != "").withColumn("has_email", has_email(F.col("email")))


def with_keywords(opportunities: DataFrame) -> DataFrame:
    keywords = F.from_json("metadata", "keywords array<string>")["keywords"]
    return opportunities.withColumn("keywords", F.coalesce(keywords, F.array().cast("array<string>")))
