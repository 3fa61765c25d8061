"""The two pre-aggregations the reports can share.

A rollup keeps the bill columns' names, with ``cost_usd`` summed and the number
of lines in ``line_count``, so every operator accepts it in place of raw lines
and returns the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from costlens import schema as S
from costlens.functions.numeric import line_count, total_cost


def _rollup(bills: DataFrame, *keys: str) -> DataFrame:
    return bills.groupBy(*keys).agg(
        total_cost().alias(S.COST), line_count(bills).alias(S.LINES)
    )


def daily_rollup(bills: DataFrame, *further: str) -> DataFrame:
    """One row per day, service and region (and ``further`` keys): enough for all but resource reports."""
    return _rollup(bills, S.USAGE_DATE, S.SERVICE, S.REGION, *further)


def resource_rollup(bills: DataFrame) -> DataFrame:
    """One row per resource, service and region: input of the resource reports."""
    return _rollup(bills, S.RESOURCE, S.SERVICE, S.REGION)
