"""What a subscription is worth against metered prices (V1-V6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranges import calendar_days

# Days of a spend period, and the lower bounds of tiers 1 to 9.
PERIOD_DAYS = {"weekly": 7.0, "monthly": 365.25 / 12, "yearly": 365.25}
TIERS = (0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0)


def prorated_cost(monthly: Column, a: Column, b: Column) -> Column:
    """Monthly spend times days over 30; zero where that is not a finite number."""
    cost = monthly * calendar_days(a, b) / 30
    return F.when(F.isnan(cost) | (F.abs(cost) == float("inf")) | cost.isNull(), 0.0).otherwise(cost)


def value_multiple(usd: Column, subscription: Column) -> Column:
    return F.when(subscription > 0, usd / subscription)


def daily_spend(amount: Column, period: Column) -> Column:
    length = F.create_map(*[F.lit(x) for pair in PERIOD_DAYS.items() for x in pair])
    return amount / length[period]


def range_multiple(usd: Column, per_day: Column, days: Column) -> Column:
    spend = per_day * days
    return F.when((usd > 0) & (spend > 0), usd / spend)


def tier(multiple: Column) -> Column:
    """0 below the first bound up to 9 at the last and above."""
    return sum(((multiple >= bound).cast("int") for bound in TIERS), F.lit(0))


def milestone(usd: Column) -> Column:
    """Full hundreds of dollars reached."""
    return F.floor(usd / 100)
