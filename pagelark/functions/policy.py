"""Deterministic calculations and threshold policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months below which a level holds, with its score; fixed values.
RUNWAY_LEVELS = ((3, "critical", 90), (6, "high", 80), (12, "medium", 60))
RUNWAY_REST = ("low", 20)
PERIOD_MONTHS = (3, 6, 9, 12)
FORMULA = "cash / (abs(operating_cash_flow) / period_months)"


def monthly_runway(cash: Column, monthly_burn: Column) -> Column:
    """cash / burn where the burn is positive."""
    return F.when(monthly_burn > 0, F.try_divide(cash, monthly_burn))


def runway_failure(cash: Column, flow: Column, months: Column) -> Column:
    """Why a runway can't be computed, null if it can."""
    return (
        F.when(cash.isNull() | flow.isNull(), "cash and operating_cash_flow must be valid numeric values")
        .when(cash < 0, "cash must be non-negative")
        .when(flow >= 0, "operating_cash_flow must be negative to represent cash burn")
        .when(months.isNull() | ~months.isin(*PERIOD_MONTHS), "period_months must be one of 3, 6, 9, or 12")
    )


def runway_months(cash: Column, flow: Column, months: Column) -> Column:
    """Months to two places, half up, from exact integers: no intermediate quotient is rounded."""
    hundredths = lambda x: (x * 10000).cast("decimal(32,0)")
    top, burn = hundredths(cash) * months * 200, hundredths(F.abs(flow))
    whole = F.floor(F.try_divide(top + burn, burn * 2)).cast("decimal(30,0)")
    return (whole / 100).cast("decimal(28,2)")


def runway_level(cash: Column, flow: Column, months: Column) -> Column:
    """struct<level, score>; compared by products, so that boundaries are exact."""
    have, burn = cash * months, F.abs(flow)
    out = None
    for below, level, score in RUNWAY_LEVELS:
        value = F.struct(F.lit(level).alias("level"), F.lit(score).alias("score"))
        out = F.when(have < burn * below, value) if out is None else out.when(have < burn * below, value)
    return out.otherwise(F.struct(F.lit(RUNWAY_REST[0]).alias("level"), F.lit(RUNWAY_REST[1]).alias("score")))


def monthly_burn(flow: Column, months: Column) -> Column:
    return F.try_divide(F.abs(flow), months).cast("decimal(38,10)")


def share_of(part: Column, whole: Column) -> Column:
    """part / whole where the whole is positive."""
    return F.when(whole > 0, F.try_divide(part, whole))


def concentration_level(largest: Column, top_five: Column) -> Column:
    """Percentages of the largest and of the five largest."""
    return F.when((largest >= 50) | (top_five >= 80), "high").when((largest >= 30) | (top_five >= 60), "medium")


def growth_level(growth: Column) -> Column:
    """Percentage of change against the comparable period."""
    return F.when(growth <= -20, "high").when(growth < 0, "medium")


def loss_level(periods: Column) -> Column:
    """Consecutive comparable periods with a loss."""
    return F.when(periods >= 3, "high").when(periods == 2, "medium")


def presence_level(present: Column, material: Column) -> Column:
    """A finding that was looked for: unclear ones go to review."""
    return F.when(present.isNull(), "needs_review").when(present & F.coalesce(material, F.lit(False)), "high").when(present, "medium").otherwise("none")


def score_level(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")
