"""Joins of the views without broadcasts, one part and supplier owning a third of the lines."""

import duckdb
import pytest
from oracle import SF_DIR, differences
from plans import executed
from pyspark.sql import functions as F

import __spark_entry__ as registry

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("hot")
    for name in ("lineitem", "part", "supplier", "nation", "region"):
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        if name == "lineitem":
            hot = F.xxhash64("l_orderkey", "l_linenumber") % 3 == 0
            for column, key in (("l_partkey", 7), ("l_suppkey", 3)):
                value = F.when(hot, F.lit(key)).otherwise(F.col(column)).cast("bigint")
                table = table.withColumn(column, value)
            table = table.repartition(6)
        table.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture
def no_broadcast(spark):
    before = {key: spark.conf.get(key) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize(
    "name",
    ["daily_rollup", "resource_rollup", "region_ranking", "kpis", "growth_all_services",
     "outlier_alerts_all", "alert_feed", "top_resources", "facets"],
)
def test_hot_keys_change_no_result(spark, no_broadcast, hot_dir, name):
    con = duckdb.connect()
    for table in ("lineitem", "part", "supplier", "nation", "region"):
        con.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{hot_dir}/{table}.parquet/*.parquet')"
        )
    query = registry.queries()[name](spark, hot_dir)
    assert differences(query, con, registry.oracle_sql()[name]) == []


def test_hot_part_is_split_or_summed_before_the_join(spark, no_broadcast, hot_dir):
    plan = executed(registry.queries()["daily_rollup"](spark, hot_dir))
    assert any("skew=true" in line for line in plan)
    plan = executed(registry.queries()["service_cost_stats"](spark, hot_dir))
    join = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line)
    assert any("partial_sum" in line for line in plan[join:])
