"""Bill lines read from the order and event tables of a test-data directory.

Every row of the fact table with a date and an amount is one bill line. A view
holds the columns asked for, with the lines summed over the others as in a
rollup; date and resource together, or ``every_line``, keep every line. Amounts
are the same decimals on either path. The dimension keys are unique, so a
dimension that is not asked for need not be joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens import schema as S

# Declared so that opening a table starts no job to read its schema.
_SCHEMAS = {
    "lineitem": "l_partkey bigint, l_suppkey bigint, l_extendedprice double, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_type string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def _wanted(columns: Iterable[str]) -> list[str]:
    wanted = set(columns)
    unknown = wanted - set(S.BILL_COLUMNS)
    if unknown:
        raise ValueError(f"not bill columns: {sorted(unknown)}")
    return [c for c in S.BILL_COLUMNS if c in wanted]


def _money(amount: str) -> str:
    return f"cast({amount} as {S.MONEY.simpleString()})"


def _sum(lines: DataFrame, keys: Iterable[str], amount: str) -> DataFrame:
    return lines.groupBy(*keys).agg(
        F.expr(f"sum({_money(amount)})").alias(S.COST), F.expr("count(1)").alias(S.LINES)
    )


def _resum(sums: DataFrame, keys: Iterable[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(
        F.sum(S.COST).alias(S.COST), F.expr(f"sum({S.LINES})").alias(S.LINES)
    )


def _select(lines: DataFrame, exprs: dict[str, str], columns: Iterable[str]) -> DataFrame:
    return lines.selectExpr(*[f"{exprs[c]} as {c}" for c in columns])


def bill_from_lineitem(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str] = S.BILL_COLUMNS,
    every_line: bool = False,
) -> DataFrame:
    """Line items as bills: part type is the service, supplier's region the region.

    Without the date, lines are summed by part and supplier before the joins: a
    part with very many lines reaches the join as one row, and the shuffle by its
    key serves the sum and the join. With the date there is little to sum at that
    point; there a hot part is left to the adaptive skew join.
    """
    wanted = _wanted(columns)
    dimensions = [c for c in wanted if c != S.COST]
    source = {S.SERVICE: "l_partkey", S.RESOURCE: "l_partkey", S.REGION: "l_suppkey"}
    keys = sorted({source[c] for c in wanted if c in source})
    dated = S.USAGE_DATE in wanted
    every_line = every_line or (dated and S.RESOURCE in wanted)

    def table(name: str) -> DataFrame:
        return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    lines = table("lineitem").filter("l_shipdate is not null and l_extendedprice is not null")
    if dated:
        lines = lines.withColumn("l_day", F.to_date("l_shipdate"))
    summed = not every_line and not (dated and keys)
    if summed:
        lines = _sum(lines, [*keys, "l_day"] if dated else keys, "l_extendedprice")
    if S.SERVICE in wanted:
        part = table("part").withColumnRenamed("p_partkey", "l_partkey")
        lines = lines.join(part, "l_partkey", "left")
    if S.REGION in wanted:
        lines = lines.join(_supplier_regions(spark, sf_dir, table), "l_suppkey", "left")

    exprs = {
        S.USAGE_DATE: "l_day",
        S.SERVICE: "coalesce(p_type, '')",
        S.REGION: "coalesce(r_name, '')",
        S.RESOURCE: "concat('part-', l_partkey)",
        S.COST: S.COST if summed else _money("l_extendedprice"),
        "l_extendedprice": "l_extendedprice",
        S.LINES: S.LINES,
    }
    if every_line:
        return _select(lines, exprs, wanted)
    if not summed:
        lines = _select(lines, exprs, [*dimensions, "l_extendedprice"])
        lines = _sum(lines, dimensions, "l_extendedprice")
    else:
        lines = _select(lines, exprs, [*dimensions, S.COST, S.LINES])
        if S.RESOURCE not in wanted and keys:
            lines = _resum(lines, dimensions)
    return _asked(lines, wanted)


def _asked(sums: DataFrame, wanted: list[str]) -> DataFrame:
    measures = [S.COST, S.LINES] if S.COST in wanted else []
    return sums.select(*[c for c in wanted if c != S.COST], *measures)


def _supplier_regions(
    spark: SparkSession, sf_dir: str, table: Callable[[str], DataFrame]
) -> DataFrame:
    """The region name of each supplier."""
    regions = table("region").withColumnRenamed("r_regionkey", "n_regionkey")
    nations = table("nation").join(regions, "n_regionkey", "left")
    suppliers = table("supplier").selectExpr("s_suppkey as l_suppkey", "s_nationkey as n_nationkey")
    return suppliers.join(nations, "n_nationkey", "left").select("l_suppkey", "r_name")


def bill_from_events(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] = S.BILL_COLUMNS
) -> DataFrame:
    """Events as bills: the event type is the service, the user the resource."""
    wanted = _wanted(columns)
    exprs = {
        S.USAGE_DATE: "to_date(ts)",
        S.SERVICE: "coalesce(event_type, '')",
        S.REGION: "concat('k-', user_id % 4)",
        S.RESOURCE: "concat('user-', user_id)",
        S.COST: _money("value"),
        "value": "value",
    }
    events = spark.read.schema(_SCHEMAS["events"]).parquet(f"{sf_dir}/events.parquet")
    events = events.filter("ts is not null and value is not null")
    if S.USAGE_DATE in wanted and S.RESOURCE in wanted:
        return _select(events, exprs, wanted)
    dimensions = [c for c in wanted if c != S.COST]
    events = _select(events, exprs, [*dimensions, "value"])
    return _asked(_sum(events, dimensions, "value"), wanted)
