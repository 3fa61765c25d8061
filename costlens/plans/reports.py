"""The standard reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from costlens import schema as S
from costlens.operators import rollups, spend


class Reports:
    """All reports of one bill frame in two passes over its lines.

    The daily rollup is cached and feeds all reports but that of resources.
    """

    def __init__(self, bills: DataFrame, weekdays: Sequence[str] = S.WEEKDAYS_EN) -> None:
        self.bills, self.weekdays = bills, weekdays
        self.daily = rollups.daily_rollup(bills).cache()

    def frames(self) -> dict[str, DataFrame]:
        return {
            "monthly_spend": spend.monthly_spend(self.daily),
            "excluded_months": spend.excluded_months(self.daily),
            "region_ranking": spend.region_ranking(self.daily),
            "top_resources": spend.top_resources(self.bills),
            "weekday_profile": spend.weekday_profile(self.daily, self.weekdays),
            "monthly_change": spend.monthly_change(self.daily),
        }

    def close(self) -> None:
        self.daily.unpersist()
