"""Headline indicators in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.functions.numeric import as_double, pct_change, total_cost
from costlens.functions.text import dollars, signed_pct


def latest_change(months: DataFrame) -> DataFrame:
    """Change of the last of ``months`` against the one before; NULL below two."""
    last_two = (
        months.orderBy(F.desc(S.MONTH))
        .limit(2)
        .agg(
            F.max_by("total_cost", S.MONTH).alias("last"),
            F.min_by("total_cost", S.MONTH).alias("previous"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    change = pct_change(as_double(F.col("last")), as_double(F.col("previous")))
    return last_two.select(F.when(F.col("n") == 2, change).alias("month_change_pct"))


def kpis(bills: DataFrame, months: DataFrame) -> DataFrame:
    """Total, mean per present day, top service and last month's change.

    ``bills`` are the filtered lines or their rollup; ``months`` the complete
    months of all lines, which the filters do not touch. No bills, no row.
    """
    by_day_service = bills.groupBy(S.USAGE_DATE, S.SERVICE).agg(
        total_cost().alias(S.COST)
    )
    days = by_day_service.groupBy(S.USAGE_DATE).agg(F.sum(S.COST).alias(S.COST))
    services = by_day_service.groupBy(S.SERVICE).agg(F.sum(S.COST).alias(S.COST))
    # the smallest pair: largest cost first, then the alphabetically first name
    top = services.agg(F.min_by(S.SERVICE, F.struct(-F.col(S.COST), F.col(S.SERVICE))))
    total = as_double(F.col(S.COST))
    change = F.col("month_change_pct")
    return (
        days.agg(F.sum(S.COST).alias(S.COST), F.count(F.lit(1)).alias("n_days"))
        .filter(F.col("n_days") > 0)
        .select(
            total.alias("total_cost"),
            (total / F.col("n_days")).alias("daily_mean"),
            top.scalar().alias("top_service"),
            latest_change(months).scalar().alias("month_change_pct"),
        )
        .withColumn(
            "change_direction",
            F.when(change > 0, "inverse").when(change <= 0, "normal").otherwise("off"),
        )
    )


def kpi_texts(indicators: DataFrame) -> DataFrame:
    """The indicators as display texts."""
    return indicators.select(
        dollars(F.col("total_cost")).alias("total_cost"),
        dollars(F.col("daily_mean")).alias("daily_mean"),
        "top_service",
        F.coalesce(signed_pct(F.col("month_change_pct")), F.lit("N/A")).alias("month_change"),
        "change_direction",
    )
