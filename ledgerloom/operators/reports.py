"""One-row progress reports, and the offer that goes out to a lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import money, pace
from ledgerloom.operators.aggregates import catalog_counts, days_running, one_row, sales_total, totals
from ledgerloom.schemas import moment

# Texts of the offer.
OFFER_HEADLINE = ("Get 50 More ", " Prompts + Templates")
OFFER_DESCRIPTION = "The full pack includes 50 tested prompts, 5 workflow templates, and a quick-start guide."
OFFER_PRICE = "$17"
OFFER_CTA = "Get the Full Pack — $17"
KEYWORD_SEARCH = " how to guide best tools"


def _pace(tx: DataFrame, elapsed: Column, goal: float, horizon: int) -> DataFrame:
    """Net result, days gone and left, and what is still needed per day."""
    rows = totals(tx).select(
        money.usd(F.col("net")).alias("net"), elapsed.alias("days_elapsed"),
        pace.days_left(elapsed, horizon).alias("days_remaining"),
    )
    return rows.withColumns({
        "remaining": F.lit(float(goal)) - F.col("net"),
        "required_daily_rate": pace.required_daily(F.col("net"), goal, F.col("days_remaining")),
    })


def finance_pace(tx: DataFrame, start: str, as_of: str, goal: float, horizon: int) -> DataFrame:
    """Goal pace with the days as they are, zero and negative included."""
    rows = _pace(tx, pace.whole_days(moment(start), moment(as_of)), goal, horizon)
    daily = F.col("net") / F.greatest(F.lit(1).cast("bigint"), F.col("days_elapsed"))
    return rows.select(
        "days_elapsed", "days_remaining", F.col("net").alias("earned"), "remaining", "required_daily_rate",
        pace.on_track(daily, goal, horizon).alias("on_track"),
    )


def analytics_pace(tx: DataFrame, start: str, as_of: str, goal: float, horizon: int) -> DataFrame:
    """Goal pace counting at least one day, with the actual rate and the share reached."""
    elapsed = F.greatest(F.lit(1).cast("bigint"), pace.whole_days(moment(start), moment(as_of)))
    rows = _pace(tx, elapsed, goal, horizon)
    daily = F.col("net") / F.col("days_elapsed")
    return rows.select(
        "days_elapsed", "days_remaining", F.col("net").alias("earned_net"), "remaining", "required_daily_rate",
        daily.alias("actual_daily_rate"), pace.on_track(daily, goal, horizon).alias("on_track"),
        pace.percent_of_goal(F.col("net"), goal).alias("pct_complete"),
    )


def run_rate(tx: DataFrame, products: DataFrame, goal: float, as_of: str) -> DataFrame:
    """Sale revenue, its monthly rate since the first product, and the share of the goal."""
    revenue = F.col("revenue")
    parts = one_row(
        sales_total(tx).select(money.usd(revenue).alias("revenue")),
        days_running(products, as_of).select("days_running"),
    )
    return parts.select(
        revenue, "days_running", pace.monthly_run_rate(revenue, F.col("days_running")).alias("run_rate"),
        pace.shown_percent(revenue, goal).alias("pct"),
    )


def status_line(tx: DataFrame, products: DataFrame, goal: int) -> DataFrame:
    """Progress in one line of text."""
    parts = one_row(totals(tx).select("net", "sales"), catalog_counts(products).select("total_listed"))
    pct = F.round(pace.percent_of_goal(money.usd(F.col("net")), goal), 1).cast("decimal(38,1)")
    return parts.select(F.concat(
        F.lit("[STATUS] Revenue: $"), F.round("net", 2).cast("string"), F.lit(f" / ${goal} ("),
        pct.cast("string"), F.lit("%) | Products: "), F.col("total_listed").cast("string"),
        F.lit(" | Sales: "), F.col("sales").cast("string"),
    ).alias("line"))


def lead_offers(leads: DataFrame, url: str) -> DataFrame:
    """The paid offer and the keyword search that go with a lead's niche."""
    niche = F.col("niche")
    before, after = OFFER_HEADLINE
    return leads.select(
        "id", F.concat(F.lit(before), niche, F.lit(after)).alias("headline"),
        F.lit(OFFER_DESCRIPTION).alias("description"), F.lit(OFFER_PRICE).alias("price"), F.lit(url).alias("url"),
        F.lit(OFFER_CTA).alias("cta"), F.concat(niche, F.lit(KEYWORD_SEARCH)).alias("search_query"),
    )
