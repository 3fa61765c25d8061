"""Spend by month, day, weekday, service, region and resource."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.functions.dates import month_of, weekday_label
from costlens.functions.numeric import (
    as_double,
    line_count,
    pct_change,
    round_half_even,
    round_half_up,
    total_cost,
)

DAYS, MOMENT = "days", "moment"


def _days(bills: DataFrame, *by: str) -> DataFrame:
    """Exact cost per day, with optional further keys."""
    return bills.groupBy(*by, S.USAGE_DATE).agg(total_cost().alias(S.COST))


def daily_spend(bills: DataFrame) -> DataFrame:
    """Cost per day; days without lines are absent."""
    return (
        _days(bills)
        .select(S.USAGE_DATE, as_double(F.col(S.COST)).alias("total_cost"))
        .orderBy(S.USAGE_DATE)
    )


def month_state(bills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One mergeable row for each month (and key): exact cost, a bit for each day with lines,
    and the sum of cost times day of the month.

    One shuffle of a row for each month, key and task: the days need none of their own, as
    bits of the same day fall together. States of parts of the lines, or by further keys,
    can be merged (``merge_months``).
    """
    # Months as numbers: lines need no text made of their dates.
    month = F.year(S.USAGE_DATE) * 12 + F.month(S.USAGE_DATE) - 1
    day = F.dayofmonth(S.USAGE_DATE)
    bit = F.call_function("shiftleft", F.lit(1), day - 1)
    grouped = bills.groupBy(*by, month.alias("_month"))
    moment = F.sum(F.col(S.COST) * day.cast("decimal(2,0)")).alias(MOMENT)
    state = grouped.agg(total_cost().alias(S.COST), F.bit_or(bit).alias(DAYS), moment)
    first = F.make_date(F.floor(F.col("_month") / 12).cast("int"), F.pmod("_month", F.lit(12)) + 1, F.lit(1))
    return state.select(*by, month_of(first).alias(S.MONTH), S.COST, DAYS, MOMENT)


def merge_months(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of the same months put together, by fewer keys or from several tables."""
    return states.groupBy(*by, S.MONTH).agg(
        total_cost().alias(S.COST), F.bit_or(DAYS).alias(DAYS), F.sum(MOMENT).alias(MOMENT)
    )


def months_of(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rounded cost and number of distinct days of each state, exact, unsorted."""
    return states.select(
        *by,
        S.MONTH,
        round_half_up(F.col(S.COST)).alias("total_cost"),
        F.bit_count(DAYS).cast("bigint").alias("days_with_data"),
    )


def all_months(bills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rounded cost and number of distinct days for each month (and key), exact, unsorted."""
    return months_of(month_state(bills, by), by)


def complete_months(
    bills: DataFrame, min_days: int = S.COMPLETE_MONTH_DAYS, by: Sequence[str] = ()
) -> DataFrame:
    return all_months(bills, by).filter(F.col("days_with_data") >= min_days)


def _month_report(months: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return months.withColumn("total_cost", as_double(F.col("total_cost"))).orderBy(*by, S.MONTH)


def monthly_spend(
    bills: DataFrame, min_days: int = S.COMPLETE_MONTH_DAYS, by: Sequence[str] = ()
) -> DataFrame:
    """Cost per month with at least ``min_days`` days of data, also of each key by itself."""
    return _month_report(complete_months(bills, min_days, by), by)


def excluded_months(
    bills: DataFrame, min_days: int = S.COMPLETE_MONTH_DAYS, by: Sequence[str] = ()
) -> DataFrame:
    """The months ``monthly_spend`` leaves out."""
    return _month_report(all_months(bills, by).filter(F.col("days_with_data") < min_days), by)


def monthly_change(bills: DataFrame, min_days: int = S.COMPLETE_MONTH_DAYS) -> DataFrame:
    """Complete months with the change from the complete month before, in percent.

    The window has no partition key; it sees one row per calendar month.
    """
    cost = as_double(F.col("total_cost"))
    previous = F.lag(cost).over(Window.orderBy(S.MONTH))
    return (
        complete_months(bills, min_days)
        .select(
            S.MONTH,
            cost.alias("total_cost"),
            "days_with_data",
            round_half_even(pct_change(cost, previous)).alias("change_pct"),
        )
        .orderBy(S.MONTH)
    )


def region_ranking(bills: DataFrame) -> DataFrame:
    """Cost, lines and share of the total per region; shares are of rounded sums."""
    regions = bills.groupBy(S.REGION).agg(
        round_half_up(total_cost()).alias("total_cost"),
        line_count(bills).alias("line_count"),
    )
    # Every region has lines. Naming the count here keeps the subquery's
    # aggregation the same as the main one, so the bills are scanned once.
    counted = F.when(F.col("line_count") > 0, F.col("total_cost"))
    grand_total = regions.agg(as_double(F.sum(counted))).scalar()
    cost = as_double(F.col("total_cost"))
    share = F.try_divide(cost, grand_total) * 100
    return regions.select(
        S.REGION,
        cost.alias("total_cost"),
        "line_count",
        round_half_even(share, 1).alias("pct_of_total"),
    ).orderBy(F.desc("total_cost"), S.REGION)


def region_totals(bills: DataFrame) -> DataFrame:
    """Unrounded cost per region, ascending."""
    return (
        bills.groupBy(S.REGION)
        .agg(as_double(total_cost()).alias("total_cost"))
        .orderBy("total_cost", S.REGION)
    )


def service_distribution(bills: DataFrame) -> DataFrame:
    """Cost and share of the total per service, largest first."""
    services = bills.groupBy(S.SERVICE).agg(total_cost().alias(S.COST))
    grand_total = services.agg(as_double(F.sum(S.COST))).scalar()
    cost = as_double(F.col(S.COST))
    return services.select(
        S.SERVICE,
        cost.alias("total_cost"),
        (F.try_divide(cost, grand_total) * 100).alias("pct_of_total"),
    ).orderBy(F.desc("total_cost"), S.SERVICE)


_RESOURCE_KEYS = (S.RESOURCE, S.SERVICE, S.REGION)


def top_resources(bills: DataFrame, n: int = S.TOP_RESOURCES) -> DataFrame:
    """The ``n`` costliest resources, ranked by the rounded sum."""
    return (
        bills.groupBy(*_RESOURCE_KEYS)
        .agg(round_half_up(total_cost()).alias("total_cost"))
        .orderBy(F.desc("total_cost"), *_RESOURCE_KEYS)
        .limit(n)
        .withColumn("total_cost", as_double(F.col("total_cost")))
    )


def top_resources_exact(bills: DataFrame, n: int = S.TOP_RESOURCES) -> DataFrame:
    """The ``n`` costliest resources, ranked by the exact sum and then rounded."""
    return (
        bills.groupBy(*_RESOURCE_KEYS)
        .agg(total_cost().alias("total_cost"))
        .orderBy(F.desc("total_cost"), *_RESOURCE_KEYS)
        .limit(n)
        .withColumn("total_cost", round_half_even(F.col("total_cost")))
    )


def weekday_profile(bills: DataFrame, labels: Sequence[str] = S.WEEKDAYS_EN) -> DataFrame:
    """Mean cost per bill line (not per day) and lines per weekday, Sunday first."""
    mean = F.try_divide(as_double(F.col(S.COST)), F.col("line_count"))
    return (
        bills.groupBy(F.dayofweek(S.USAGE_DATE).alias("day"))
        .agg(total_cost().alias(S.COST), line_count(bills).alias("line_count"))
        .select(
            weekday_label(F.col("day"), labels).alias("weekday"),
            round_half_up(mean).alias("avg_cost"),
            "line_count",
        )
        .orderBy("weekday")
    )
