"""Distinct unions and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.feeds import top_pending
from ledgerloom.operators.filters import creation_tasks
from ledgerloom.operators.joins import distinct_keys

# Topics used when no source has any.
DEFAULT_TOPICS = (
    "AI prompt packs", "Notion templates", "automation tools", "passive income", "digital downloads",
)
SEARCH, FEED, DEFAULT = 0, 1, 2


def topics(searched: DataFrame, feed: DataFrame | None) -> DataFrame:
    """Distinct topics and the first source that has them: search titles, then feed titles.

    Without a feed the search titles stand alone, and the default topics stand in for no titles.
    """
    found = searched.where(F.col("title") != "").select(F.col("title").alias("topic"), F.lit(SEARCH).alias("source"))
    if feed is not None:
        found = found.unionByName(feed.select(F.col("title").alias("topic"), F.lit(FEED).alias("source")))
    else:
        topic = F.explode(F.array(*[F.lit(t) for t in DEFAULT_TOPICS])).alias("topic")
        defaults = searched.sparkSession.range(1).select(topic, F.lit(DEFAULT).alias("source"))
        found = found.unionByName(defaults.where(~found.exists()))
    return found.groupBy("topic").agg(F.min("source").alias("source"))


def work_list(messages: DataFrame, opportunities: DataFrame, agent: str, k: int = 3) -> DataFrame:
    """Pending opportunities that ``agent`` was asked to make, else the best ``k`` pending ones."""
    mine = (F.col("to_agent") == agent) | F.col("to_agent").isNull()
    asked = distinct_keys(creation_tasks(messages.where(mine & (F.col("read") == 0))), "opportunity_id", "id")
    columns = ("id", "title", "type", "estimated_revenue")
    pending = opportunities.where(F.col("status") == "pending")
    messaged = pending.join(asked, "id", "left_semi").select(*columns, F.lit("message").alias("origin"))
    best = top_pending(opportunities, k).select(*columns, F.lit("fallback").alias("origin"))
    return messaged.unionByName(best.where(~messaged.exists()))
