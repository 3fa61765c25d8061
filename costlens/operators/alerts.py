"""Alerts: services that grew fast and resources far above their service."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.functions.dates import month_of
from costlens.functions.joins import join_per_key
from costlens.functions.numeric import (
    as_double,
    pct_change,
    round_half_even,
    total_cost,
)
from costlens.functions.text import dollars, one_decimal


@dataclass(frozen=True)
class Wording:
    """Texts of the alerts; the templates name the alert's columns."""

    growth_type: str
    outlier_type: str
    growth_title: str
    growth_text: str
    outlier_title: str
    outlier_text: str


# Alert types and texts.
ENGLISH = Wording(
    growth_type="Service growing",
    outlier_type="Resource outlier",
    growth_title="{service} grew {change_pct}%",
    growth_text="From {previous_cost} to {current_cost} in the last month",
    outlier_title="{resource_id} ({service})",
    outlier_text="Cost of {cost} — service mean: {service_mean}",
)
PORTUGUESE = Wording(
    growth_type="Serviço em alta",
    outlier_type="Recurso outlier",
    growth_title="{service} cresceu {change_pct}%",
    growth_text="De {previous_cost} para {current_cost} no último mês",
    outlier_title="{resource_id} ({service})",
    outlier_text="Gasto de {cost} — média do serviço: {service_mean}",
)


def _per_day(bills: DataFrame) -> DataFrame:
    """Exact cost per day and service, with the month.

    The month is made from the summed rows, not line by line, and is never null:
    a join on it then adds no null test below the sum, which would keep the two
    sides from sharing one scan and shuffle of the bills.
    """
    return (
        bills.filter(F.col(S.USAGE_DATE).isNotNull())
        .groupBy(S.USAGE_DATE, S.SERVICE)
        .agg(total_cost().alias(S.COST))
        .withColumn(S.MONTH, F.coalesce(month_of(S.USAGE_DATE), F.lit("")))
    )


def month_service_spend(bills: DataFrame) -> DataFrame:
    """Cost per month and service."""
    return (
        _per_day(bills)
        .groupBy(S.MONTH, S.SERVICE)
        .agg(as_double(F.sum(S.COST)).alias("total_cost"))
        .orderBy(S.MONTH, S.SERVICE)
    )


def growth_alerts(
    bills: DataFrame,
    threshold_pct: float = S.GROWTH_THRESHOLD_PCT,
    complete_months_only: bool = False,
    min_days: int = S.COMPLETE_MONTH_DAYS,
    wording: Wording = ENGLISH,
) -> DataFrame:
    """Services whose cost rose by ``threshold_pct`` or more over the last two months.

    The two months are the latest present, complete or not, unless
    ``complete_months_only``. A service needs lines in both and a positive cost
    in the earlier one. Fewer than two months give no alert.
    """
    stored = S.MONTH in bills.columns
    if stored:
        # A table partitioned by month: the join prunes all partitions but two when it runs.
        latest = _aged(_stored_months(bills, complete_months_only, min_days))
        spent = bills
    else:
        spent = _per_day(bills)
        days = spent.groupBy(S.USAGE_DATE, S.MONTH).agg(F.sum(S.COST).alias(S.COST))
        months = days.groupBy(S.MONTH).agg(
            F.count(F.lit(1)).alias("n_days"), F.sum(S.COST).alias(S.COST)
        )
        if complete_months_only:
            months = months.filter(F.col("n_days") >= min_days)
        latest = _aged(months.filter(F.col(S.COST).isNotNull()))
    current, previous = (
        as_double(F.sum(F.when(F.col("age") == age, F.col(S.COST)))) for age in (1, 2)
    )
    change = pct_change(F.col("current_cost"), F.col("previous_cost"))
    return (
        spent.join(F.broadcast(latest), S.MONTH)  # two rows
        .groupBy(S.SERVICE)
        .agg(current.alias("current_cost"), previous.alias("previous_cost"))
        .filter((F.col("previous_cost") > 0) & (change >= threshold_pct))
        .select(
            F.lit(wording.growth_type).alias("alert_type"),
            S.SERVICE,
            round_half_even(change, 1).alias("change_pct"),
            round_half_even(F.col("previous_cost")).alias("previous_cost"),
            round_half_even(F.col("current_cost")).alias("current_cost"),
        )
        .orderBy(F.desc("change_pct"), S.SERVICE)
    )


def _aged(months: DataFrame) -> DataFrame:
    """The latest two months, aged 1 and 2."""
    age = F.row_number().over(Window.orderBy(F.desc(S.MONTH)))
    return months.orderBy(F.desc(S.MONTH)).limit(2).select(S.MONTH, age.alias("age"))


def _stored_months(bills: DataFrame, complete_only: bool, min_days: int) -> DataFrame:
    """The table's months, from the partitions or, for complete ones, the dates alone."""
    named = bills.filter(F.col(S.MONTH) > "")  # a side without any filter prunes nothing
    if not complete_only:
        return named.select(S.MONTH).distinct()
    bit = F.call_function("shiftleft", F.lit(1), F.dayofmonth(S.USAGE_DATE) - 1)
    days = named.groupBy(S.MONTH).agg(F.bit_count(F.bit_or(bit)).alias("n_days"))
    return days.filter(F.col("n_days") >= min_days).select(S.MONTH)


def _resource_totals(bills: DataFrame) -> DataFrame:
    # With the null test that joins on the service imply made here, all uses of
    # the totals share one scan and shuffle of the bills.
    return (
        bills.filter(F.col(S.SERVICE).isNotNull())
        .groupBy(S.RESOURCE, S.SERVICE)
        .agg(total_cost().alias(S.COST))
        .withColumn("cost", as_double(F.col(S.COST)))
    )


def _service_stats(totals: DataFrame, std_factor: float, min_resources: int) -> DataFrame:
    # the mean of an exact sum: one of doubles could round either way
    mean = as_double(F.sum(S.COST)) / F.count(F.lit(1))
    return (
        totals.groupBy(S.SERVICE)
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("resource_count"),
            mean.alias("service_mean"),
            F.stddev_samp("cost").alias("cost_std"),
        )
        .filter(F.col("resource_count") >= min_resources)
        .withColumn("threshold", F.col("service_mean") + std_factor * F.col("cost_std"))
    )


def service_cost_stats(
    bills: DataFrame,
    std_factor: float = S.OUTLIER_STD_FACTOR,
    min_resources: int = S.OUTLIER_MIN_RESOURCES,
) -> DataFrame:
    """Mean, sample deviation and alert threshold of resource costs per service."""
    stats = _service_stats(_resource_totals(bills), std_factor, min_resources)
    return stats.orderBy(S.SERVICE)


def outlier_alerts(
    bills: DataFrame,
    top_n: int | None = S.OUTLIER_TOP_N,
    std_factor: float = S.OUTLIER_STD_FACTOR,
    min_resources: int = S.OUTLIER_MIN_RESOURCES,
    wording: Wording = ENGLISH,
) -> DataFrame:
    """Resources costing more than mean + ``std_factor`` deviations of their service.

    The ``top_n`` costliest over all services; None gives every one.
    """
    totals = _resource_totals(bills)
    stats = _service_stats(totals, std_factor, min_resources)
    # equal costs have no outlier, whatever the last bit of their mean
    outliers = (
        join_per_key(totals, stats, S.SERVICE, spread_by=S.RESOURCE)
        .filter((F.col("cost_std") > 0) & (F.col("cost") > F.col("threshold")))
        .select(
            F.lit(wording.outlier_type).alias("alert_type"),
            S.RESOURCE,
            S.SERVICE,
            round_half_even(F.col("cost")).alias("cost"),
            round_half_even(F.col("service_mean")).alias("service_mean"),
        )
        .orderBy(F.desc("cost"), S.SERVICE, S.RESOURCE)
    )
    return outliers if top_n is None else outliers.limit(top_n)


def alert_feed(
    bills: DataFrame,
    threshold_pct: float = S.GROWTH_THRESHOLD_PCT,
    top_n: int | None = S.OUTLIER_TOP_N,
    wording: Wording = ENGLISH,
    daily: DataFrame | None = None,
    complete_months_only: bool = False,
    min_days: int = S.COMPLETE_MONTH_DAYS,
    std_factor: float = S.OUTLIER_STD_FACTOR,
    min_resources: int = S.OUTLIER_MIN_RESOURCES,
) -> DataFrame:
    """Growth alerts, then outlier alerts; ``family_rank`` and ``score`` give the order.

    ``daily`` may hold the daily rollup of ``bills`` where it is at hand already.
    """
    daily = bills if daily is None else daily
    growth = growth_alerts(daily, threshold_pct, complete_months_only, min_days, wording).withColumns(
        {"family_rank": F.lit(1), "score": F.col("change_pct")}
    )
    outliers = outlier_alerts(bills, top_n, std_factor, min_resources, wording).withColumns(
        {"family_rank": F.lit(2), "score": F.col("cost")}
    )
    return growth.unionByName(outliers, allowMissingColumns=True).orderBy(*_feed_order())


def _feed_order() -> list[Column]:
    return [F.col("family_rank"), F.desc("score"), F.col(S.SERVICE), F.col(S.RESOURCE)]


def alert_cards(feed: DataFrame, n: int = S.ALERT_CARDS, wording: Wording = ENGLISH) -> DataFrame:
    """The first ``n`` alerts of the feed with title, description and severity."""
    growth = F.col("family_rank") == 1
    return (
        feed.orderBy(*_feed_order())
        .limit(n)
        .select(
            "family_rank",
            "alert_type",
            F.when(growth, _fill(wording.growth_title))
            .otherwise(_fill(wording.outlier_title))
            .alias("title"),
            F.when(growth, _fill(wording.growth_text))
            .otherwise(_fill(wording.outlier_text))
            .alias("description"),
            F.when(growth, "red").otherwise("orange").alias("severity"),
        )
    )


def _fill(template: str) -> Column:
    """A template with its named columns put in, formatted."""
    money = ("previous_cost", "current_cost", "cost", "service_mean")
    columns = {c: dollars(F.col(c), 2) for c in money} | {
        "change_pct": one_decimal(F.col("change_pct")),
        S.SERVICE: F.col(S.SERVICE),
        S.RESOURCE: F.col(S.RESOURCE),
    }
    pieces = Formatter().parse(template)
    return F.concat(
        *[
            part
            for text, name, _, _ in pieces
            for part in ([F.lit(text)] if text else []) + ([columns[name]] if name else [])
        ]
    )
