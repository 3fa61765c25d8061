"""Row filters, facet values and date bounds."""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens import schema as S

Day = dt.date | str


def filter_bills(
    bills: DataFrame,
    service: str | None = None,
    region: str | None = None,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Keep one service, one region and an inclusive date range; None keeps all.

    The range applies only when both ends are given; one alone is ignored with a
    warning. On a table partitioned by month it also bounds the month, which is what
    prunes partitions: a predicate on the date alone does not.
    """
    if service is not None:
        bills = bills.filter(F.col(S.SERVICE) == F.lit(service))
    if region is not None:
        bills = bills.filter(F.col(S.REGION) == F.lit(region))
    if start is not None and end is not None:
        first, last = _day(start), _day(end)
        bills = bills.filter(F.col(S.USAGE_DATE).between(F.lit(first), F.lit(last)))
        if S.MONTH in bills.columns:
            months = (F.lit(d.strftime("%Y-%m")) for d in (first, last))
            bills = bills.filter(F.col(S.MONTH).between(*months))
    elif start is not None or end is not None:
        warnings.warn("a date range with one end is ignored", stacklevel=2)
    return bills


def _day(day: Day) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def facets(bills: DataFrame) -> DataFrame:
    """Distinct services and regions as ``facet, value`` rows, in one scan."""
    pairs = bills.select(S.SERVICE, S.REGION).distinct()
    kinds = [
        F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in (S.SERVICE, S.REGION)
    ]
    return pairs.select(F.inline(F.array(*kinds))).distinct().orderBy("facet", "value")


def date_bounds(bills: DataFrame) -> DataFrame:
    """First and last usage date; no row when there are no bills.

    On a table partitioned by month only the first and the last month are read: which
    ones they are is found from the partitions alone, and a join prunes the others when
    the query runs.
    """
    if S.MONTH in bills.columns:
        named = bills.filter(F.col(S.MONTH) > "")  # a side without any filter prunes nothing
        ends = named.agg(F.min(S.MONTH).alias("first"), F.max(S.MONTH).alias("last"))
        ends = ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias(S.MONTH))
        bills = bills.join(F.broadcast(ends), S.MONTH)  # two rows at most
    return (
        bills.agg(
            F.min(S.USAGE_DATE).alias("first_date"),
            F.max(S.USAGE_DATE).alias("last_date"),
        )
        .filter(F.col("first_date").isNotNull())
    )
