"""Progress toward a revenue goal over a fixed number of days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MICROS = 86_400_000_000


def whole_days(start: Column, end: Column) -> Column:
    """Full days from ``start`` to ``end``; negative before the start."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.floor(micros / F.lit(DAY_MICROS)).cast("bigint")


def days_left(elapsed: Column, horizon: int) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.lit(horizon) - elapsed)


def required_daily(net: Column, goal: float, left: Column) -> Column:
    return F.when(left > 0, (F.lit(float(goal)) - net) / left).otherwise(F.lit(0.0))


def on_track(daily: Column, goal: float, horizon: int) -> Column:
    return daily >= F.lit(float(goal) / horizon)


def percent_of_goal(net: Column, goal: float) -> Column:
    return net / F.lit(float(goal)) * 100


def shown_percent(net: Column, goal: float) -> Column:
    """Share of the goal to one decimal, full at one hundred."""
    return F.least(F.lit(100.0), F.round(percent_of_goal(net, goal), 1))


def monthly_run_rate(revenue: Column, days: Column) -> Column:
    return F.when(days > 0, revenue / days * 30).otherwise(F.lit(0.0))
