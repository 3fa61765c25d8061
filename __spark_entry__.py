"""

``entry(spark)`` is the smoke check. Each ``queries()[name]`` takes the session
and a test-data directory; ``oracle_sql()[name]`` is the same result as DuckDB
SQL over the same tables.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.operators import alerts, filters, forecast, kpis, rollups, spend
from costlens.plans.dashboard import Dashboard
from costlens.plans.ingest import load_bills
from costlens.session import scratch_dir
from costlens.sources import bill_csv, bill_table, files, rollup_table
from costlens.sources.views import bill_from_events, bill_from_lineitem

Query = Callable[[SparkSession, str], DataFrame]

DATE, SERVICE, REGION, RESOURCE, COST = S.BILL_COLUMNS

RANGE = ("1996-01-15", "1998-06-30")
GROWTH_RANGE = ("1995-01-01", "2001-03-31")


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round double columns so that the last bits of two engines compare equal."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def entry(spark: SparkSession) -> DataFrame:
    bills = bill_from_lineitem(spark, "/root/testdata/sf0.001", [DATE, COST])
    return spend.monthly_spend(bills)


# --- queries -----------------------------------------------------------------


def _over(view, columns, operator, **kwargs) -> Query:
    return lambda spark, sf_dir: operator(view(spark, sf_dir, columns), **kwargs)


def _lineitem(operator, *columns: str, **kwargs) -> Query:
    return _over(bill_from_lineitem, columns, operator, **kwargs)


def _events(operator, *columns: str, **kwargs) -> Query:
    return _over(bill_from_events, columns, operator, **kwargs)


def _both(name: str, operator, *columns: str, **kwargs) -> dict[str, Query]:
    return {
        name: _lineitem(operator, *columns, **kwargs),
        f"{name}_events": _events(operator, *columns, **kwargs),
    }


def _region_totals(bills: DataFrame) -> DataFrame:
    return spend.region_totals(filters.filter_bills(bills, "PROMO", None, *RANGE))


def _service_distribution(bills: DataFrame) -> DataFrame:
    services = spend.service_distribution(filters.filter_bills(bills, None, "ASIA", *RANGE))
    return _rounded(services, pct_of_total=6)


def _top_resources_filtered(bills: DataFrame) -> DataFrame:
    return spend.top_resources_exact(filters.filter_bills(bills, "PROMO", "ASIA", *RANGE))


def _filtered_daily(bills: DataFrame) -> DataFrame:
    return spend.daily_spend(filters.filter_bills(bills, "PROMO", "ASIA", *RANGE))


def _monthly_from_rollup(bills: DataFrame) -> DataFrame:
    return spend.monthly_spend(rollups.daily_rollup(bills))


def _daily_rollup(bills: DataFrame) -> DataFrame:
    rollup = rollups.daily_rollup(bills)
    return rollup.withColumn(COST, F.col(COST).cast("double"))


def _resource_rollup(bills: DataFrame) -> DataFrame:
    rollup = rollups.resource_rollup(bills)
    return rollup.withColumn(COST, F.col(COST).cast("double"))


def _kpi_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bill_from_lineitem(spark, sf_dir, [DATE, SERVICE, REGION, COST])
    months = spend.complete_months(bill_from_lineitem(spark, sf_dir, [DATE, COST]))
    return kpis.kpis(filters.filter_bills(lines, None, "ASIA", *RANGE), months)


def _kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_kpi_frame(spark, sf_dir), daily_mean=6, month_change_pct=6)


def _kpi_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.kpi_texts(_kpi_frame(spark, sf_dir))


def _kpis_one_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills = bill_from_events(spark, sf_dir, [DATE, SERVICE, COST])
    return _rounded(kpis.kpis(bills, spend.complete_months(bills)), daily_mean=6)


def _service_cost_stats(bills: DataFrame) -> DataFrame:
    stats = alerts.service_cost_stats(bills)
    return _rounded(stats, service_mean=4, cost_std=4, threshold=4)


def _trend_fit(bills: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _rounded(forecast.trend_fit(bills, by), slope=6, intercept=6)


def _forecast(bills: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _rounded(forecast.forecast(bills, by=by), predicted_cost=4)


def _projection(bills: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    projected = forecast.projection_texts(forecast.projection(bills, by=by))
    return _rounded(projected, predicted_total=4, last_30_days=4, change_pct=6)


def _trend_series(bills: DataFrame) -> DataFrame:
    return _rounded(forecast.trend_series(bills), total_cost=4)


def _growth_alerts(bills: DataFrame) -> DataFrame:
    return alerts.growth_alerts(bills)


def _growth_alerts_filtered(bills: DataFrame) -> DataFrame:
    return alerts.growth_alerts(filters.filter_bills(bills, None, None, *GROWTH_RANGE))


def _growth_all_services(bills: DataFrame) -> DataFrame:
    return alerts.growth_alerts(bills, threshold_pct=-100.0)


def _growth_complete_months(bills: DataFrame) -> DataFrame:
    return alerts.growth_alerts(bills, threshold_pct=-100.0, complete_months_only=True)


def _alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bill_from_lineitem(spark, sf_dir, [DATE, SERVICE, RESOURCE, COST])
    daily = bill_from_lineitem(spark, sf_dir, [DATE, SERVICE, COST])
    return alerts.alert_feed(
        lines, threshold_pct=-100.0, daily=daily, complete_months_only=True
    )


def _alert_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_cards(_alert_feed(spark, sf_dir))


def _with_files(build: Callable[[SparkSession, str, str], DataFrame]) -> Query:
    """A query that writes files on its way: they go once its result is stored."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_dir(spark)
        try:
            result = build(spark, sf_dir, folder)
            result.write.parquet(f"{folder}-result")
        finally:
            files.delete(spark, folder)
        return spark.read.schema(result.schema).parquet(f"{folder}-result")

    return run


def _exported(bills: DataFrame, folder: str) -> str:
    bill_csv.write_bill_csv(bills, f"{folder}/csv")
    return f"{folder}/csv"


def _ingest_csv(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    path = _exported(bill_from_lineitem(spark, sf_dir), folder)
    lines = bill_csv.valid_lines(bill_csv.parse_bill_csv(spark, path))
    return lines.withColumn(COST, F.col(COST).cast("double"))


def _ingest_rejects(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Bad dates for one service, bad costs for one region, then counted by reason."""
    bills = bill_from_lineitem(spark, sf_dir)
    bad_date = F.when(F.col(SERVICE) == "SMALL", "31/12/1999").otherwise(
        F.col(DATE).cast("string")
    )
    bad_cost = F.when(F.col(REGION) == "EUROPE", "n/a").otherwise(F.col(COST).cast("decimal(20,2)").cast("string"))
    text = bills.withColumns({DATE: bad_date, COST: bad_cost})
    names = [F.col(c).alias(name) for c, name in S.CSV_HEADER.items()]
    text.select(*names).write.option("header", True).csv(f"{folder}/csv")
    parsed = bill_csv.parse_bill_csv(spark, f"{folder}/csv")
    reason = F.coalesce(bill_csv.REJECT_REASON, F.lit("valid"))
    return parsed.groupBy(reason.alias("outcome")).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(COST).cast("double").alias("total_cost"),
        F.min(bill_csv.FIELDS).alias("first_fields"),
        F.max(bill_csv.FIELDS).alias("last_fields"),
    )


def _ingest_small_costs(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Costs with ten digits behind the point, written as text and read again."""
    bills = bill_from_lineitem(spark, sf_dir)
    small = (F.col(COST) / F.lit(10**8)).cast(S.MONEY)
    path = _exported(bills.withColumn(COST, small), folder)
    lines = bill_csv.valid_lines(bill_csv.parse_bill_csv(spark, path))
    totals = lines.groupBy(SERVICE).agg(F.sum(COST).alias("total"), F.count(F.lit(1)).alias("line_count"))
    return totals.select(SERVICE, "line_count", F.col("total").cast("string").alias("total_cost"))


_CSV_ORDER = [RESOURCE, DATE, SERVICE, REGION, COST]


def _exported_in_order(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """CSV files whose lines, over all files, are in an order that SQL can repeat."""
    return _exported(bill_from_lineitem(spark, sf_dir).orderBy(*_CSV_ORDER), folder)


def _ids_by_month(spark: SparkSession, table: str) -> DataFrame:
    stored = bill_table.read_bills(spark, table, line_ids=True)
    return stored.groupBy(S.MONTH).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.min(S.LINE_ID).alias("first_id"),
        F.max(S.LINE_ID).alias("last_id"),
        F.sum(S.LINE_ID).alias("id_sum"),
        F.sum(COST).cast("double").alias("total_cost"),
    )


def _table_load(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    load_bills(spark, _exported_in_order(spark, sf_dir, folder), f"{folder}/bills", strict=True)
    return _ids_by_month(spark, f"{folder}/bills")


def _table_load_rejects(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Ids where every service PROMO line is rejected between valid ones."""
    ordered = bill_from_lineitem(spark, sf_dir).orderBy(*_CSV_ORDER)
    bad = F.when(F.col(SERVICE) == "PROMO", "n/a").otherwise(F.col(COST).cast("string"))
    text = ordered.withColumns({COST: bad, DATE: F.col(DATE).cast("string")})
    names = [F.col(c).alias(name) for c, name in S.CSV_HEADER.items()]
    text.select(*names).write.option("header", True).csv(f"{folder}/csv")
    load_bills(spark, f"{folder}/csv", f"{folder}/bills", f"{folder}/rejects")
    return _ids_by_month(spark, f"{folder}/bills")


def _table_replaced(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A report planned on one version of the table while two others replace it."""
    bills = bill_from_lineitem(spark, sf_dir)
    bill_table.replace_bills(bills, f"{folder}/bills")
    planned = bill_table.read_bills(spark, f"{folder}/bills")
    bill_table.replace_bills(bills.filter(F.col(REGION) == "ASIA"), f"{folder}/bills")
    now = bill_table.read_bills(spark, f"{folder}/bills")
    parts = [df.groupBy(REGION).agg(F.count(F.lit(1)).alias("line_count"), F.sum(COST).cast("double").alias("total_cost"))
             .withColumn("version", F.lit(name)) for name, df in (("planned", planned), ("now", now))]
    return parts[0].unionByName(parts[1])


def _ingest_multi_line(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Services with line breaks, quotes and commas, written and read again by many tasks."""
    bills = bill_from_lineitem(spark, sf_dir)
    broken = F.concat(F.lit("a "), SERVICE, F.lit('\n"'), REGION, F.lit('",\n'))
    path = _exported(bills.withColumn(SERVICE, broken), folder)
    lines = bill_csv.valid_lines(bill_csv.parse_bill_csv(spark, path, multi_line=True))
    return lines.groupBy(SERVICE, DATE).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(COST).cast("double").alias("total_cost")
    )


def _load_audit(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """What a load reports: lines stored (as compared with those read) and lines rejected."""
    bills = bill_from_lineitem(spark, sf_dir)
    bad = F.when(F.col(REGION) == "EUROPE", "n/a").otherwise(F.col(COST).cast("string"))
    text = bills.withColumns({COST: bad, DATE: F.col(DATE).cast("string")})
    text.select(*[F.col(c).alias(n) for c, n in S.CSV_HEADER.items()]).write.option("header", True).csv(f"{folder}/csv")
    audit = load_bills(spark, f"{folder}/csv", f"{folder}/bills", f"{folder}/rejects")
    stored = spark.read.parquet(f"{folder}/rejects")
    kept = stored.agg(F.count(F.lit(1)).alias("reject_rows"))
    return kept.select(F.lit(audit.lines).cast("long").alias("lines"), F.lit(audit.rejects).cast("long").alias("rejects"), "reject_rows")


def _stored_rollup(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The rollup kept by a load, after another load in which only some months differ."""
    bills = bill_from_lineitem(spark, sf_dir)
    fewer = bills.filter((F.year(DATE) != 1995) | (F.col(REGION) != "ASIA"))
    for i, lines in enumerate((fewer, bills)):
        load_bills(spark, _exported(lines, f"{folder}/{i}"), f"{folder}/bills", strict=True)
    daily = rollup_table.read_daily(spark, f"{folder}/bills")
    return daily.drop(S.MONTH).withColumn(COST, F.col(COST).cast("double"))


def _dashboard_of_table(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A dashboard's regions under filters, from the stored rollup."""
    load_bills(spark, _exported(bill_from_lineitem(spark, sf_dir), folder), f"{folder}/bills", strict=True)
    page = Dashboard.of_table(spark, f"{folder}/bills")
    return page.view("PROMO", None, *RANGE)["region_totals"]


def _months_merged(bills: DataFrame) -> DataFrame:
    """Months of all lines, merged from states by region and service."""
    merged = spend.merge_months(spend.month_state(bills, [SERVICE, REGION]))
    return spend.months_of(merged).withColumn("total_cost", F.col("total_cost").cast("double"))


def _fit_of_months(bills: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Fits from month states by service and region, merged as asked for."""
    states = spend.month_state(bills, [c for c in (SERVICE, REGION) if c in bills.columns])
    return _rounded(forecast.fit_of_months(states, by), slope=6, intercept=6)


def _no_kpis(bills: DataFrame) -> DataFrame:
    return kpis.kpis(bills.filter(F.col(SERVICE) == "no such service"), spend.complete_months(bills))


def _no_projection(bills: DataFrame) -> DataFrame:
    return forecast.projection(bills.filter(F.col(DATE) < "1900-01-01"))


def _on_table(operator, **kwargs) -> Query:
    """The operator over the stored table."""

    def build(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
        bill_table.replace_bills(bill_from_lineitem(spark, sf_dir), f"{folder}/bills")
        return operator(bill_table.read_bills(spark, f"{folder}/bills"), **kwargs)

    return _with_files(build)


def _on_lines(operator, *columns: str, **kwargs) -> Query:
    """The operator over raw lines, nothing summed before it."""
    return lambda spark, sf_dir: operator(
        bill_from_lineitem(spark, sf_dir, columns, every_line=True), **kwargs
    )


def bill_queries() -> dict[str, Query]:
    """One entry per operator on bills; each runs over whole tables."""
    stats = (SERVICE, RESOURCE, COST)
    return {
        "monthly_spend": _lineitem(spend.monthly_spend, DATE, COST),
        "monthly_spend_rollup": _lineitem(_monthly_from_rollup, DATE, SERVICE, REGION, COST),
        "monthly_spend_by_service": _lineitem(spend.monthly_spend, DATE, SERVICE, COST, by=(SERVICE,)),
        "excluded_months_by_resource": _lineitem(
            spend.excluded_months, DATE, RESOURCE, COST, by=(RESOURCE,), min_days=2
        ),
        "months_merged": _lineitem(_months_merged, DATE, SERVICE, REGION, COST),
        "excluded_months": _lineitem(spend.excluded_months, DATE, COST),
        "monthly_change": _lineitem(spend.monthly_change, DATE, COST),
        "region_ranking": _lineitem(spend.region_ranking, REGION, COST),
        "region_totals": _lineitem(_region_totals, DATE, SERVICE, REGION, COST),
        "service_distribution": _lineitem(_service_distribution, DATE, SERVICE, REGION, COST),
        "top_resources": _lineitem(spend.top_resources, *stats, REGION),
        "top_resources_filtered": _lineitem(_top_resources_filtered, *S.BILL_COLUMNS),
        "weekday_profile": _lineitem(spend.weekday_profile, DATE, COST),
        "weekday_profile_pt": _lineitem(
            spend.weekday_profile, DATE, COST, labels=S.WEEKDAYS_PT
        ),
        "daily_spend": _lineitem(spend.daily_spend, DATE, COST),
        "filtered_daily": _lineitem(_filtered_daily, DATE, SERVICE, REGION, COST),
        "daily_rollup": _lineitem(_daily_rollup, DATE, SERVICE, REGION, COST),
        "resource_rollup": _lineitem(_resource_rollup, *stats, REGION),
        "facets": _lineitem(filters.facets, SERVICE, REGION),
        "date_bounds": _lineitem(filters.date_bounds, DATE),
        "kpis": _kpis,
        "kpi_texts": _kpi_texts,
        "kpis_one_month": _kpis_one_month,
        "month_service_spend": _lineitem(alerts.month_service_spend, DATE, SERVICE, COST),
        **_both("service_cost_stats", _service_cost_stats, *stats),
        **_both("trend_features", forecast.trend_features, DATE, COST),
        **_both("trend_fit", _trend_fit, DATE, COST),
        "trend_fit_of_months": _lineitem(_fit_of_months, DATE, SERVICE, REGION, COST),
        "trend_fit_of_months_by_service": _lineitem(
            _fit_of_months, DATE, SERVICE, REGION, COST, by=(SERVICE,)
        ),
        "trend_fit_by_service": _lineitem(_trend_fit, DATE, SERVICE, COST, by=(SERVICE,)),
        **_both("forecast_30d", _forecast, DATE, COST),
        "forecast_by_service": _lineitem(_forecast, DATE, SERVICE, COST, by=(SERVICE,)),
        **_both("projection_30d", _projection, DATE, COST),
        "projection_by_service": _lineitem(_projection, DATE, SERVICE, COST, by=(SERVICE,)),
        **_both("trend_series", _trend_series, DATE, COST),
        "growth_alerts": _lineitem(_growth_alerts, DATE, SERVICE, COST),
        "growth_alerts_filtered": _lineitem(_growth_alerts_filtered, DATE, SERVICE, COST),
        "growth_all_services": _lineitem(_growth_all_services, DATE, SERVICE, COST),
        "growth_complete_months": _lineitem(_growth_complete_months, DATE, SERVICE, COST),
        **_both("outlier_alerts", alerts.outlier_alerts, *stats),
        **_both("outlier_alerts_all", alerts.outlier_alerts, *stats, top_n=None),
        "alert_feed": _alert_feed,
        "alert_cards": _alert_cards,
        "ingest_csv": _with_files(_ingest_csv),
        "ingest_rejects": _with_files(_ingest_rejects),
        "ingest_small_costs": _with_files(_ingest_small_costs),
        "ingest_multi_line": _with_files(_ingest_multi_line),
        "table_load": _with_files(_table_load),
        "table_load_rejects": _with_files(_table_load_rejects),
        "table_replaced": _with_files(_table_replaced),
        "load_audit": _with_files(_load_audit),
        "stored_rollup": _with_files(_stored_rollup),
        "dashboard_of_table": _with_files(_dashboard_of_table),
        "kpis_no_lines": _lineitem(_no_kpis, DATE, SERVICE, COST),
        "projection_no_lines": _lineitem(_no_projection, DATE, COST),
        "table_filtered_daily": _on_table(_filtered_daily),
        "table_growth": _on_table(alerts.growth_alerts, threshold_pct=-100.0),
        "table_date_bounds": _on_table(filters.date_bounds),
        "monthly_spend_lines": _on_lines(spend.monthly_spend, DATE, COST),
        "region_ranking_lines": _on_lines(spend.region_ranking, REGION, COST),
        "top_resources_lines": _on_lines(spend.top_resources, *stats, REGION),
        "weekday_profile_lines": _on_lines(spend.weekday_profile, DATE, COST),
        "forecast_30d_lines": _on_lines(_forecast, DATE, COST),
        "outlier_alerts_lines": _on_lines(alerts.outlier_alerts, *stats),
    }


# --- SQL ---------------------------------------------------------------------

_LINEITEM_BILLS = """
bills AS (
  SELECT CAST(l_shipdate AS DATE) AS usage_date, coalesce(p_type, '') AS service,
         coalesce(r_name, '') AS region, 'part-' || l_partkey AS resource_id,
         CAST(l_extendedprice AS DECIMAL(28,10)) AS cost_usd
  FROM lineitem
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN nation ON n_nationkey = s_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL
)"""
_EVENT_BILLS = """
bills AS (
  SELECT CAST(ts AS DATE) AS usage_date, coalesce(event_type, '') AS service,
         'k-' || user_id % 4 AS region, 'user-' || user_id AS resource_id,
         CAST(value AS DECIMAL(28,10)) AS cost_usd
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL
)"""


def _ids_sql(valid: str) -> str:
    """Ids in the order of the CSV files."""
    return f"""
numbered AS (
  SELECT *, row_number() OVER (ORDER BY resource_id, usage_date, service, region, cost_usd) AS line_id
  FROM bills WHERE {valid})"""


def _months_sql(by: str, having: str) -> str:
    key = f"{by}, " if by else ""
    return f"""
SELECT {key}strftime(usage_date, '%Y-%m') AS month, CAST(round(sum(cost_usd), 2) AS DOUBLE) AS total_cost,
       count(DISTINCT usage_date) AS days_with_data
FROM bills GROUP BY {key}strftime(usage_date, '%Y-%m') {having}"""


_IDS_SELECT = """
SELECT strftime(usage_date, '%Y-%m') AS month, count(*) AS line_count, min(line_id) AS first_id,
       max(line_id) AS last_id, CAST(sum(line_id) AS BIGINT) AS id_sum, CAST(sum(cost_usd) AS DOUBLE) AS total_cost
FROM numbered GROUP BY 1"""
_RANGE_SQL = f"usage_date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"
_FILTERED = f"service = 'PROMO' AND region = 'ASIA' AND {_RANGE_SQL}"

_MONTHS = """
months AS (
  SELECT strftime(usage_date, '%Y-%m') AS month,
         CAST(round(sum(cost_usd), 2) AS DOUBLE) AS total_cost,
         count(DISTINCT usage_date) AS days_with_data
  FROM bills GROUP BY 1
)"""


def _sql(*ctes: str, select: str, bills: str = _LINEITEM_BILLS) -> str:
    return "WITH" + ",".join([bills, *ctes]) + "\n" + select


def _daily_sql(where: str = "TRUE") -> str:
    return f"""
SELECT usage_date, CAST(sum(cost_usd) AS DOUBLE) AS total_cost
FROM bills WHERE {where} GROUP BY usage_date"""


def _top_sql(where: str, rank: str, shown: str) -> str:
    return f"""
SELECT resource_id, service, region, {shown} AS total_cost
FROM bills WHERE {where} GROUP BY resource_id, service, region
ORDER BY {rank} DESC, resource_id, service, region LIMIT 10"""


def _weekday_sql(labels: tuple[str, ...]) -> str:
    names = ", ".join(f"'{x}'" for x in labels)
    return f"""
SELECT ([{names}])[dayofweek(usage_date) + 1] AS weekday,
       round(CAST(sum(cost_usd) AS DOUBLE) / count(*), 2) AS avg_cost, count(*) AS line_count
FROM bills GROUP BY 1"""


def _scoped(where: str) -> str:
    return f"""
scoped AS (SELECT * FROM bills WHERE {where}),
days AS (SELECT usage_date, sum(cost_usd) AS c FROM scoped GROUP BY 1),
tops AS (SELECT service FROM scoped GROUP BY 1 ORDER BY sum(cost_usd) DESC, service LIMIT 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS age
           FROM months WHERE days_with_data >= 20),
change AS (SELECT (max(total_cost) FILTER (age = 1) - max(total_cost) FILTER (age = 2))
                  / nullif(max(total_cost) FILTER (age = 2), 0) * 100 AS pct FROM ranked),
kpi AS (SELECT CAST(sum(c) AS DOUBLE) AS total_cost,
               CAST(sum(c) AS DOUBLE) / count(*) AS daily_mean,
               (SELECT service FROM tops) AS top_service,
               (SELECT pct FROM change) AS month_change_pct
        FROM days HAVING count(*) > 0)"""


_DIRECTION = """CASE WHEN month_change_pct > 0 THEN 'inverse'
            WHEN month_change_pct <= 0 THEN 'normal' ELSE 'off' END AS change_direction"""
_KPI_SELECT = f"""
SELECT total_cost, round(daily_mean, 6) AS daily_mean, top_service,
       round(month_change_pct, 6) AS month_change_pct, {_DIRECTION}
FROM kpi"""
_KPI_TEXT_SELECT = f"""
SELECT '$' || format('{{:,.0f}}', total_cost) AS total_cost,
       '$' || format('{{:,.0f}}', daily_mean) AS daily_mean, top_service,
       coalesce(format('{{:+.1f}}', month_change_pct) || '%', 'N/A') AS month_change,
       {_DIRECTION}
FROM kpi"""

_STATS = """
totals AS (SELECT resource_id, service, sum(cost_usd) AS exact,
                  CAST(sum(cost_usd) AS DOUBLE) AS cost
           FROM bills GROUP BY 1, 2),
stats AS (SELECT service, count(*) AS resource_count,
                 CAST(sum(exact) AS DOUBLE) / count(*) AS service_mean,
                 stddev_samp(cost) AS cost_std,
                 CAST(sum(exact) AS DOUBLE) / count(*) + 2 * stddev_samp(cost) AS threshold
          FROM totals GROUP BY 1 HAVING count(*) >= 3)"""
_STATS_SELECT = """
SELECT service, resource_count, round(service_mean, 4) AS service_mean,
       round(cost_std, 4) AS cost_std, round(threshold, 4) AS threshold
FROM stats"""
_OUTLIERS = """
outliers AS (
  SELECT 'Resource outlier' AS alert_type, resource_id, service,
         round_even(cost * 100, 0) / 100 AS cost,
         round_even(service_mean * 100, 0) / 100 AS service_mean
  FROM totals JOIN stats USING (service) WHERE cost > threshold
)"""
_OUTLIER_ORDER = "ORDER BY cost DESC, service, resource_id"


def _growth(threshold: float, where: str = "TRUE", min_days: int = 0) -> str:
    return f"""
latest AS (
  SELECT month, row_number() OVER (ORDER BY month DESC) AS age FROM (
    SELECT strftime(usage_date, '%Y-%m') AS month FROM bills WHERE {where}
    GROUP BY 1 HAVING count(DISTINCT usage_date) >= {min_days})
  ORDER BY month DESC LIMIT 2),
pairs AS (
  SELECT service, CAST(sum(cost_usd) FILTER (age = 1) AS DOUBLE) AS cur,
         CAST(sum(cost_usd) FILTER (age = 2) AS DOUBLE) AS prev
  FROM bills JOIN latest ON month = strftime(usage_date, '%Y-%m') WHERE {where} GROUP BY 1),
growth AS (
  SELECT 'Service growing' AS alert_type, service,
         round_even((cur - prev) / prev * 100 * 10, 0) / 10 AS change_pct,
         round_even(prev * 100, 0) / 100 AS previous_cost,
         round_even(cur * 100, 0) / 100 AS current_cost
  FROM pairs WHERE cur IS NOT NULL AND prev > 0
    AND (cur - prev) / nullif(prev, 0) * 100 >= {threshold})"""


_FEED = f"""
feed AS (
  SELECT alert_type, service, change_pct, previous_cost, current_cost,
         CAST(1 AS INTEGER) AS family_rank, change_pct AS score, CAST(NULL AS VARCHAR) AS resource_id,
         CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS DOUBLE) AS service_mean
  FROM growth
  UNION ALL
  SELECT alert_type, service, NULL, NULL, NULL, 2, cost, resource_id, cost, service_mean
  FROM (SELECT * FROM outliers {_OUTLIER_ORDER} LIMIT 3))"""
_CARDS_SELECT = """
SELECT family_rank, alert_type,
       CASE family_rank WHEN 1 THEN service || ' grew ' || format('{:.1f}', change_pct) || '%'
            ELSE resource_id || ' (' || service || ')' END AS title,
       CASE family_rank
         WHEN 1 THEN 'From $' || format('{:,.2f}', previous_cost) || ' to $'
                     || format('{:,.2f}', current_cost) || ' in the last month'
         ELSE 'Cost of $' || format('{:,.2f}', cost) || ' — service mean: $'
              || format('{:,.2f}', service_mean) END AS description,
       CASE family_rank WHEN 1 THEN 'red' ELSE 'orange' END AS severity
FROM feed ORDER BY family_rank, score DESC, service, resource_id LIMIT 5"""


def _fit_ctes(by: str = "") -> str:
    """Daily totals, day index and fitted line, overall or for each ``by``."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else "HAVING count(*) > 0"
    return f"""
days AS (SELECT {key}usage_date, CAST(sum(cost_usd) AS DOUBLE) AS y FROM bills GROUP BY ALL),
idx AS (SELECT *, CAST(usage_date - min(usage_date) OVER ({part}) AS BIGINT) AS x,
               row_number() OVER ({part} ORDER BY usage_date DESC) AS age FROM days),
fit AS (SELECT {key}CASE WHEN count(*) = 1 THEN 0 ELSE regr_slope(y, x) END AS slope,
               CASE WHEN count(*) = 1 THEN avg(y) ELSE regr_intercept(y, x) END AS intercept,
               count(*) AS n_days, max(x) AS last_x, max(usage_date) AS last_date,
               sum(y) FILTER (age <= 30) AS recent
        FROM idx {group}),
future AS (SELECT {key}CAST(last_date + CAST(h AS INTEGER) AS DATE) AS usage_date,
                  greatest(intercept + slope * (last_x + h), 0) AS y
           FROM fit, range(1, 31) AS r(h))"""


def _fit_select(by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""
SELECT {key}round(slope, 6) AS slope, round(intercept, 6) AS intercept, n_days FROM fit"""


def _forecast_select(by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"SELECT {key}usage_date, round(y, 4) AS predicted_cost FROM future"


def _projection_select(by: str = "") -> str:
    key = f"{by}, " if by else ""
    total = f"SELECT {key}sum(y) AS p FROM future" + (f" GROUP BY {by}" if by else "")
    join = f"JOIN fit USING ({by})" if by else "CROSS JOIN fit"
    return f"""
SELECT {key}round(p, 4) AS predicted_total, round(recent, 4) AS last_30_days,
       round(pct, 6) AS change_pct,
       CASE WHEN pct > 10 THEN 'red' ELSE 'orange' END AS severity,
       CASE WHEN pct >= 0 THEN '+' ELSE '' END AS sign,
       '$' || format('{{:,.0f}}', p) AS total_text,
       CASE WHEN pct >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', pct) || '%' AS change_text
FROM (SELECT {key}p, recent, (p - recent) / nullif(recent, 0) * 100 AS pct
      FROM ({total}) {join})"""


_FEATURES_SELECT = "SELECT usage_date, y AS total_cost, x AS days_since_start FROM idx"
_SERIES_SELECT = """
SELECT usage_date, round(y, 4) AS total_cost, 'actual' AS series FROM days
UNION ALL SELECT usage_date, round(y, 4), 'forecast' FROM future"""


def _both_sql(name: str, *ctes: str, select: str) -> dict[str, str]:
    return {
        name: _sql(*ctes, select=select),
        f"{name}_events": _sql(*ctes, select=select, bills=_EVENT_BILLS),
    }


_FROM_LINES = (
    "monthly_spend",
    "region_ranking",
    "top_resources",
    "weekday_profile",
    "forecast_30d",
    "outlier_alerts",
)


def bill_sql() -> dict[str, str]:
    """The queries on bills as DuckDB SQL."""
    monthly = _sql(_MONTHS, select="SELECT * FROM months WHERE days_with_data >= 20")
    filtered_daily = _sql(select=_daily_sql(_FILTERED))
    half_up, half_even = "round(sum(cost_usd), 2)", "round_even(CAST(sum(cost_usd) AS DOUBLE) * 100, 0) / 100"
    in_growth = "usage_date BETWEEN DATE '{}' AND DATE '{}'".format(*GROWTH_RANGE)
    feed_ctes = (_growth(-100, min_days=20), _STATS, _OUTLIERS, _FEED)
    growth = "SELECT * FROM growth"
    out = {
        "monthly_spend": monthly,
        "monthly_spend_rollup": monthly,
        "excluded_months": _sql(_MONTHS, select="SELECT * FROM months WHERE days_with_data < 20"),
        "monthly_change": _sql(
            _MONTHS,
            """
kept AS (SELECT *, lag(total_cost) OVER (ORDER BY month) AS prev
         FROM months WHERE days_with_data >= 20)""",
            select="""
SELECT month, total_cost, days_with_data,
       round_even((total_cost - prev) / nullif(prev, 0) * 100 * 100, 0) / 100 AS change_pct
FROM kept""",
        ),
        "region_ranking": _sql(
            """
r AS (SELECT region, round(sum(cost_usd), 2) AS c, count(*) AS line_count
      FROM bills GROUP BY 1)""",
            select="""
SELECT region, CAST(c AS DOUBLE) AS total_cost, line_count,
       round_even(CAST(c AS DOUBLE) / nullif((SELECT CAST(sum(c) AS DOUBLE) FROM r), 0)
                  * 100 * 10, 0) / 10 AS pct_of_total
FROM r""",
        ),
        "region_totals": _sql(
            select=f"""
SELECT region, CAST(sum(cost_usd) AS DOUBLE) AS total_cost
FROM bills WHERE service = 'PROMO' AND {_RANGE_SQL} GROUP BY region"""
        ),
        "service_distribution": _sql(
            f"""
s AS (SELECT service, sum(cost_usd) AS c FROM bills
      WHERE region = 'ASIA' AND {_RANGE_SQL} GROUP BY 1)""",
            select="""
SELECT service, CAST(c AS DOUBLE) AS total_cost,
       round(CAST(c AS DOUBLE) / nullif((SELECT CAST(sum(c) AS DOUBLE) FROM s), 0) * 100, 6)
         AS pct_of_total
FROM s""",
        ),
        "top_resources": _sql(select=_top_sql("TRUE", half_up, f"CAST({half_up} AS DOUBLE)")),
        "top_resources_filtered": _sql(select=_top_sql(_FILTERED, "sum(cost_usd)", half_even)),
        "weekday_profile": _sql(select=_weekday_sql(S.WEEKDAYS_EN)),
        "weekday_profile_pt": _sql(select=_weekday_sql(S.WEEKDAYS_PT)),
        "daily_spend": _sql(select=_daily_sql()),
        "filtered_daily": filtered_daily,
        "daily_rollup": _sql(
            select="""
SELECT usage_date, service, region, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd,
       count(*) AS line_count
FROM bills GROUP BY ALL"""
        ),
        "resource_rollup": _sql(
            select="""
SELECT resource_id, service, region, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd,
       count(*) AS line_count
FROM bills GROUP BY ALL"""
        ),
        "facets": _sql(
            select="""
SELECT DISTINCT 'service' AS facet, service AS value FROM bills
UNION ALL SELECT DISTINCT 'region', region FROM bills"""
        ),
        "date_bounds": _sql(
            select="SELECT min(usage_date) AS first_date, max(usage_date) AS last_date FROM bills"
        ),
        "kpis": _sql(_MONTHS, _scoped(f"region = 'ASIA' AND {_RANGE_SQL}"), select=_KPI_SELECT),
        "kpi_texts": _sql(
            _MONTHS, _scoped(f"region = 'ASIA' AND {_RANGE_SQL}"), select=_KPI_TEXT_SELECT
        ),
        "kpis_one_month": _sql(_MONTHS, _scoped("TRUE"), select=_KPI_SELECT, bills=_EVENT_BILLS),
        "month_service_spend": _sql(
            select="""
SELECT strftime(usage_date, '%Y-%m') AS month, service, CAST(sum(cost_usd) AS DOUBLE) AS total_cost
FROM bills GROUP BY ALL"""
        ),
        **_both_sql("service_cost_stats", _STATS, select=_STATS_SELECT),
        **_both_sql("trend_features", _fit_ctes(), select=_FEATURES_SELECT),
        **_both_sql("trend_fit", _fit_ctes(), select=_fit_select()),
        "trend_fit_by_service": _sql(_fit_ctes("service"), select=_fit_select("service")),
        **_both_sql("forecast_30d", _fit_ctes(), select=_forecast_select()),
        "forecast_by_service": _sql(_fit_ctes("service"), select=_forecast_select("service")),
        **_both_sql("projection_30d", _fit_ctes(), select=_projection_select()),
        "projection_by_service": _sql(_fit_ctes("service"), select=_projection_select("service")),
        **_both_sql("trend_series", _fit_ctes(), select=_SERIES_SELECT),
        "growth_alerts": _sql(_growth(20), select=growth),
        "growth_alerts_filtered": _sql(_growth(20, in_growth), select=growth),
        "growth_all_services": _sql(_growth(-100), select=growth),
        "growth_complete_months": _sql(_growth(-100, min_days=20), select=growth),
        "table_growth": _sql(_growth(-100), select=growth),
        **_both_sql(
            "outlier_alerts", _STATS, _OUTLIERS,
            select=f"SELECT * FROM outliers {_OUTLIER_ORDER} LIMIT 3",
        ),
        **_both_sql("outlier_alerts_all", _STATS, _OUTLIERS, select="SELECT * FROM outliers"),
        "alert_feed": _sql(*feed_ctes, select="SELECT * FROM feed"),
        "alert_cards": _sql(*feed_ctes, select=_CARDS_SELECT),
        "ingest_csv": _sql(
            select="""
SELECT usage_date, service, region, resource_id, CAST(cost_usd AS DOUBLE) AS cost_usd FROM bills"""
        ),
        "ingest_rejects": _sql(
            select="""
SELECT CASE WHEN service = 'SMALL' THEN 'invalid date'
            WHEN region = 'EUROPE' THEN 'invalid cost' ELSE 'valid' END AS outcome,
       count(*) AS line_count,
       CAST(sum(CASE WHEN region = 'EUROPE' THEN NULL ELSE cost_usd END) AS DOUBLE) AS total_cost,
       min(fields) FILTER (service = 'SMALL' OR region = 'EUROPE') AS first_fields,
       max(fields) FILTER (service = 'SMALL' OR region = 'EUROPE') AS last_fields
FROM (SELECT *, concat_ws(',', CASE WHEN service = 'SMALL' THEN '31/12/1999' ELSE strftime(usage_date, '%Y-%m-%d') END,
                          service, region, resource_id,
                          CASE WHEN region = 'EUROPE' THEN 'n/a' ELSE CAST(CAST(cost_usd AS DECIMAL(20,2)) AS VARCHAR) END) AS fields
      FROM bills)
GROUP BY 1""",
        ),
        "ingest_multi_line": _sql(
            select="""
SELECT 'a ' || service || chr(10) || '"' || region || '",' || chr(10) AS service, usage_date,
       count(*) AS line_count, CAST(sum(cost_usd) AS DOUBLE) AS total_cost
FROM bills GROUP BY 1, 2"""
        ),
        "table_load": _sql(_ids_sql("TRUE"), select=_IDS_SELECT),
        "table_load_rejects": _sql(_ids_sql("service <> 'PROMO'"), select=_IDS_SELECT),
        "table_replaced": _sql(
            select="""
SELECT region, count(*) AS line_count, CAST(sum(cost_usd) AS DOUBLE) AS total_cost, 'planned' AS version
FROM bills GROUP BY 1
UNION ALL
SELECT region, count(*), CAST(sum(cost_usd) AS DOUBLE), 'now' FROM bills WHERE region = 'ASIA' GROUP BY 1"""
        ),
        "table_filtered_daily": filtered_daily,
        "ingest_small_costs": _sql(
            select="""
SELECT service, count(*) AS line_count,
       CAST(sum(CAST(cost_usd / 100000000 AS DECIMAL(28,10))) AS VARCHAR) AS total_cost
FROM bills GROUP BY 1"""
        ),
    }
    out |= {
        "load_audit": _sql(
            select="""
SELECT count(*) FILTER (region <> 'EUROPE') AS lines, count(*) FILTER (region = 'EUROPE') AS rejects,
       count(*) FILTER (region = 'EUROPE') AS reject_rows
FROM bills"""
        ),
        "trend_fit_of_months": out["trend_fit"],
        "trend_fit_of_months_by_service": out["trend_fit_by_service"],
        "monthly_spend_by_service": _sql(select=_months_sql("service", "HAVING count(DISTINCT usage_date) >= 20")),
        "excluded_months_by_resource": _sql(
            select=_months_sql("resource_id", "HAVING count(DISTINCT usage_date) < 2")
        ),
        "months_merged": _sql(select=_months_sql("", "")),
        "stored_rollup": out["daily_rollup"],
        "dashboard_of_table": out["region_totals"],
        "kpis_no_lines": _sql(
            select="""
SELECT CAST(sum(cost_usd) AS DOUBLE) AS total_cost,
       CAST(sum(cost_usd) AS DOUBLE) / count(DISTINCT usage_date) AS daily_mean, min(service) AS top_service,
       CAST(NULL AS DOUBLE) AS month_change_pct, 'off' AS change_direction
FROM bills WHERE service = 'no such service' HAVING count(*) > 0"""
        ),
        "projection_no_lines": _sql(
            select="""
SELECT CAST(sum(cost_usd) AS DOUBLE) AS predicted_total, CAST(sum(cost_usd) AS DOUBLE) AS last_30_days,
       CAST(NULL AS DOUBLE) AS change_pct, 'orange' AS severity, '' AS sign
FROM bills WHERE usage_date < DATE '1900-01-01' HAVING count(*) > 0"""
        ),
    }
    out |= {f"{k}_lines": out[k] for k in _FROM_LINES}
    return out | {"table_date_bounds": out["date_bounds"]}


# --- with the operators on training data, where they are installed -------------

try:
    import corpus_pipeline
    from costlens.llm import queries as llm
except ModuleNotFoundError as error:
    # The package itself or a library that only it needs may be missing; parts of this one may not.
    own = (error.name or "").startswith("costlens") and not (error.name or "").startswith("costlens.llm")
    if own:
        raise
    logging.getLogger(__name__).warning("no operators on training data: %s", error)
    llm = corpus_pipeline = None


def queries() -> dict[str, Query]:
    """Every registered query."""
    if llm is None:
        return bill_queries()
    return {**bill_queries(), **llm.queries(), "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The queries as DuckDB SQL, those that SQL can express."""
    if llm is None:
        return bill_sql()
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**bill_sql(), **llm.oracle_sql(), **pipeline}
