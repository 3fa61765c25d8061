"""Money queries on amounts with fractions of a cent, against their SQL."""

import pytest
from oracle import SF_DIR, connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as registry

NAMES = [
    "monthly_spend",
    "region_ranking",
    "daily_spend",
    "kpis",
    "top_resources",
    "top_resources_filtered",
    "service_cost_stats",
    "forecast_30d_events",
    "resource_rollup",
    "growth_complete_months",
    "alert_feed",
    "table_load",
    "monthly_spend_lines",
]


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shifted")
    for name, amount in (("lineitem", "l_extendedprice"), ("events", "value")):
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        table.withColumn(amount, F.round(F.col(amount) + 0.004, 3)).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    for name in ("part", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_fractions_of_a_cent_count(spark, shifted, name):
    con = connect(shifted)
    assert differences(registry.bill_queries()[name](spark, shifted), con, registry.bill_sql()[name]) == []
