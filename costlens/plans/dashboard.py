"""The frames behind an interactive cost page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costlens.operators import alerts, forecast, kpis, rollups, spend
from costlens.operators.filters import Day, date_bounds, facets, filter_bills
from costlens.sources.bill_table import read_bills
from costlens.sources.rollup_table import read_daily


class Dashboard:
    """Views of one bill frame under changing filters.

    The daily rollup is cached: it keeps every column the filters read, so each
    view of days, services and regions starts from it instead of the lines.
    The filtered lines are read once for a view: their resource rollup, cached
    until the next view, feeds the outliers and the top resources.
    """

    def __init__(self, bills: DataFrame, daily: DataFrame | None = None) -> None:
        self.bills = bills
        self.daily = (rollups.daily_rollup(bills) if daily is None else daily).cache()
        self.resources: DataFrame | None = None

    @classmethod
    def of_table(cls, spark: SparkSession, path: str) -> Dashboard:
        """Over a stored table: starts from the rollup that loads keep and reads no lines for it."""
        return cls(read_bills(spark, path), read_daily(spark, path))

    def choices(self) -> dict[str, DataFrame]:
        """What the filters can be set to."""
        return {"facets": facets(self.daily), "date_bounds": date_bounds(self.daily)}

    def view(
        self,
        service: str | None = None,
        region: str | None = None,
        start: Day | None = None,
        end: Day | None = None,
        wording: alerts.Wording = alerts.ENGLISH,
    ) -> dict[str, DataFrame]:
        """All frames under the filters, with the texts shown for them; months stay unfiltered."""
        daily = filter_bills(self.daily, service, region, start, end)
        lines = filter_bills(self.bills, service, region, start, end)
        self._drop_resources()
        self.resources = rollups.resource_rollup(lines).cache()
        feed = alerts.alert_feed(self.resources, wording=wording, daily=daily)
        indicators = kpis.kpis(daily, spend.complete_months(self.daily))
        projected = forecast.projection(daily)
        return {
            "kpis": indicators,
            "kpi_texts": kpis.kpi_texts(indicators),
            "monthly_spend": spend.monthly_spend(self.daily),
            "service_distribution": spend.service_distribution(daily),
            "trend_series": forecast.trend_series(daily),
            "projection": projected,
            "projection_texts": forecast.projection_texts(projected).select("total_text", "change_text", "severity"),
            "alert_cards": alerts.alert_cards(feed, wording=wording),
            "region_totals": spend.region_totals(daily),
            "top_resources": spend.top_resources_exact(self.resources),
        }

    def _drop_resources(self) -> None:
        if self.resources is not None:
            self.resources.unpersist()
            self.resources = None

    def close(self) -> None:
        self._drop_resources()
        self.daily.unpersist()
