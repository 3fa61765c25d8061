"""Least-squares trend over daily spend, forecast and projection.

Each function takes ``by``, the columns to fit separately (none by default);
that equals filtering to each key's lines and fitting those alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.functions.numeric import as_double, pct_change, total_cost
from costlens.functions.text import dollars, one_decimal
from costlens.operators import spend


def _days(bills: DataFrame, by: Sequence[str]) -> DataFrame:
    return bills.groupBy(*by, S.USAGE_DATE).agg(as_double(total_cost()).alias("total_cost"))


def trend_features(bills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily spend with the days since the first day; gaps in dates stay gaps.

    The window holds one row per calendar day and key.
    """
    first = F.min(S.USAGE_DATE).over(Window.partitionBy(*by))
    return (
        _days(bills, by)
        .withColumn("days_since_start", F.datediff(S.USAGE_DATE, first).cast("bigint"))
        .orderBy(*by, S.USAGE_DATE)
    )


def _fit(days: DataFrame, by: Sequence[str], *extra: Column) -> DataFrame:
    """One row per key: slope, intercept at the first day, first and last day."""
    x = F.unix_date(S.USAGE_DATE)
    y = F.col("total_cost")
    slope = F.coalesce(F.col("slope"), F.lit(0.0))  # NULL for a single day
    at_start = F.col("mean_y") - slope * (F.col("mean_x") - F.unix_date("first_date"))
    return (
        days.groupBy(*by)
        .agg(
            F.min(S.USAGE_DATE).alias("first_date"),
            F.max(S.USAGE_DATE).alias("last_date"),
            F.count(F.lit(1)).cast("bigint").alias("n_days"),
            F.avg(x).alias("mean_x"),
            F.avg(y).alias("mean_y"),
            F.regr_slope(y, as_double(x)).alias("slope"),
            *extra,
        )
        .filter(F.col("n_days") > 0)
        .withColumns({"slope": slope, "intercept": at_start})
        .drop("mean_x", "mean_y")
    )


def trend_fit(bills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slope per day and intercept at the first day."""
    return _fit(_days(bills, by), by).select(*by, "slope", "intercept", "n_days")


def fit_of_months(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``trend_fit`` out of month states (``spend.month_state``), without the days themselves.

    States by any further keys, of any choice of months or of parts of the lines may be
    given: days with lines are bits, so those of several states fall together, and all
    sums are exact until the last step. Days are counted from the first one, gaps stay gaps.
    """
    months = spend.merge_months(states, by)
    start = F.unix_date(F.to_date(F.concat(S.MONTH, F.lit("-01"))))
    each = F.filter(
        F.sequence(F.lit(0), F.lit(30)), lambda d: F.call_function("shiftright", F.col(spend.DAYS), d).bitwiseAND(F.lit(1)) == 1
    )
    days = F.transform(each, lambda d: (start + d).cast("bigint"))
    exact = "decimal(38,10)"

    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(days, F.lit(0).cast("bigint"), lambda a, x: a + of(x))

    # x counts from 1970; the sums of cost are those of the days' costs, whatever the lines.
    sums = months.select(
        *by,
        F.array_min(days).alias("first"),
        F.size(days).cast("bigint").alias("n"),
        total(lambda x: x).alias("sx"),
        total(lambda x: x * x).alias("sxx"),
        F.col(S.COST).cast(exact).alias("sy"),
        (F.col(spend.MOMENT) + (start - 1).cast("decimal(8,0)") * F.col(S.COST)).cast(exact).alias("sxy"),
    )
    fit = sums.groupBy(*by).agg(
        F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sy", "sxy")]
    )
    n, first = F.col("n"), F.col("first")
    shifted = {
        "sxy": (F.col("sxy") - first.cast("decimal(8,0)") * F.col("sy")).cast("double"),
        "sxx": F.col("sxx") - 2 * first * F.col("sx") + n * first * first,
        "sx": F.col("sx") - n * first,
        "sy": as_double(F.col("sy")),
    }
    spread = n * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.coalesce(F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), spread), F.lit(0.0))
    return (
        fit.filter(n > 0)
        .withColumns(shifted)
        .withColumn("slope", slope)
        .select(*by, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / n).alias("intercept"), n.alias("n_days"))
    )


def _future(horizon: int, value: str) -> Column:
    """Array of the days after ``last_date`` with the clipped trend value."""
    if horizon < 1:
        raise ValueError("horizon must be at least one day")
    span = F.datediff("last_date", "first_date")

    def day(h: Column) -> Column:
        trend = F.col("intercept") + F.col("slope") * (span + h)
        return F.struct(
            F.date_add("last_date", h).alias(S.USAGE_DATE),
            F.greatest(trend, F.lit(0.0)).alias(value),
        )

    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), day)


def _predict(fit: DataFrame, by: Sequence[str], horizon: int) -> DataFrame:
    return fit.select(*by, F.inline(_future(horizon, "predicted_cost")))


def forecast(
    bills: DataFrame, horizon: int = S.FORECAST_DAYS, by: Sequence[str] = ()
) -> DataFrame:
    """Predicted cost for each of the ``horizon`` days after the last, at least zero."""
    fit = _fit(_days(bills, by), by)
    return _predict(fit, by, horizon).orderBy(*by, S.USAGE_DATE)


def trend_series(
    bills: DataFrame, horizon: int = S.FORECAST_DAYS, by: Sequence[str] = ()
) -> DataFrame:
    """Daily spend followed by its forecast, told apart by ``series``."""
    days = _days(bills, by)
    future = _predict(_fit(days, by), by, horizon)
    actual = days.withColumn("series", F.lit("actual"))
    predicted = future.withColumnRenamed("predicted_cost", "total_cost").withColumn(
        "series", F.lit("forecast")
    )
    return actual.unionByName(predicted).orderBy(*by, S.USAGE_DATE)


def projection(
    bills: DataFrame,
    horizon: int = S.FORECAST_DAYS,
    tail: int = S.TAIL_DAYS,
    by: Sequence[str] = (),
    red_pct: float = S.PROJECTION_RED_PCT,
) -> DataFrame:
    """Forecast total against the last ``tail`` days that have data.

    The tail and the fit come from one pass over the days; the window holds one
    row per calendar day and key.
    """
    newest_first = Window.partitionBy(*by).orderBy(F.desc(S.USAGE_DATE))
    days = _days(bills, by).withColumn("age", F.row_number().over(newest_first))
    recent = F.sum(F.when(F.col("age") <= tail, F.col("total_cost")))
    predicted = F.aggregate(
        _future(horizon, "predicted_cost"),
        F.lit(0.0),
        lambda total, day: total + day["predicted_cost"],
    )
    change = F.col("change_pct")
    return (
        _fit(days, by, recent.alias(f"last_{tail}_days"))
        .withColumn("predicted_total", predicted)
        .select(
            *by,
            "predicted_total",
            f"last_{tail}_days",
            pct_change(F.col("predicted_total"), F.col(f"last_{tail}_days")).alias("change_pct"),
        )
        .withColumns(
            {
                "severity": F.when(change > red_pct, "red").otherwise("orange"),
                "sign": F.when(change >= 0, "+").otherwise(""),
            }
        )
    )


def projection_texts(projected: DataFrame) -> DataFrame:
    """The projection's total and signed change as display texts."""
    change = F.concat("sign", one_decimal(F.col("change_pct")), F.lit("%"))
    return projected.withColumns(
        {"total_text": dollars(F.col("predicted_total")), "change_text": change}
    )
