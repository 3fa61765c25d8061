import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.operators import rollups, spend

START = dt.date(2024, 1, 1)


def days(first, n, cost="1.00", service="EC2", resource="r"):
    first = dt.date.fromisoformat(first)
    return [
        (first + dt.timedelta(days=i), service, "us", f"{resource}", cost) for i in range(n)
    ]


def test_month_needs_twenty_days(bills, rows):
    frame = bills(
        *days("2024-01-01", 19),
        *days("2024-01-05", 1),  # a second line on a day is not a second day
        *days("2024-02-01", 20),
        *days("2024-03-01", 31),
    )
    assert rows(spend.monthly_spend(frame)) == [("2024-02", 20.0, 20), ("2024-03", 31.0, 31)]
    assert rows(spend.excluded_months(frame)) == [("2024-01", 20.0, 19)]
    assert rows(spend.monthly_spend(frame, min_days=19))[0] == ("2024-01", 20.0, 19)


def test_change_skips_incomplete_month(bills, rows):
    frame = bills(
        *days("2024-01-01", 20, "1.00"),
        *days("2024-02-01", 5, "9.00"),
        *days("2024-03-01", 20, "1.50"),
    )
    assert rows(spend.monthly_change(frame)) == [
        ("2024-01", 20.0, 20, None),
        ("2024-03", 30.0, 20, 50.0),
    ]


def test_change_from_zero_is_null(bills, rows):
    frame = bills(*days("2024-01-01", 20, "0"), *days("2024-02-01", 20, "1"))
    assert [r[-1] for r in rows(spend.monthly_change(frame))] == [None, None]


def test_sums_round_half_up_and_are_exact(bills, rows):
    lines = [(d, s, g, f"{i}", "0.001") for i, (d, s, g, _, _) in enumerate(days("2024-01-01", 25))]
    assert rows(spend.monthly_spend(bills(*lines)))[0][1] == 0.03  # 0.025


def test_region_share_of_rounded_sums(bills, rows):
    frame = bills(
        ("2024-01-01", "s", "a", "r", "2.00"),
        ("2024-01-01", "s", "b", "r", "0.99"),
        ("2024-01-01", "s", "b", "r", "0.01"),
    )
    assert rows(spend.region_ranking(frame)) == [("a", 2.0, 1, 66.7), ("b", 1.0, 2, 33.3)]


def test_share_of_nothing_is_null(bills, rows):
    frame = bills(("2024-01-01", "s", "a", "r", "0"), ("2024-01-01", "t", "a", "r", "0"))
    assert rows(spend.region_ranking(frame)) == [("a", 0.0, 2, None)]
    assert [r[2] for r in rows(spend.service_distribution(frame))] == [None, None]


def test_region_totals_ascend_unrounded(bills, rows):
    frame = bills(("2024-01-01", "s", "b", "r", "1.005"), ("2024-01-01", "s", "a", "r", "3"))
    assert rows(spend.region_totals(frame)) == [("b", 1.005), ("a", 3.0)]


def test_shared_resource_is_split_by_region_and_ties_go_by_key(bills, rows):
    frame = bills(
        ("2024-01-01", "s", "b", "r", "5"),
        ("2024-01-01", "s", "a", "r", "5"),
        ("2024-01-01", "s", "a", "q", "5"),
    )
    expected = [("q", "s", "a", 5.0), ("r", "s", "a", 5.0), ("r", "s", "b", 5.0)]
    assert rows(spend.top_resources(frame)) == expected
    assert rows(spend.top_resources(frame, 2)) == expected[:2]


def test_rounding_before_or_after_ranking(bills, rows):
    frame = bills(
        ("2024-01-01", "s", "a", "a", "5.001"),
        ("2024-01-01", "s", "a", "b", "5.002"),
    )
    assert [r[0] for r in rows(spend.top_resources(frame))] == ["a", "b"]  # tie at 5.00
    assert [r[0] for r in rows(spend.top_resources_exact(frame))] == ["b", "a"]


def test_weekday_mean_is_per_line(bills, rows):
    frame = bills(
        ("2024-01-07", "s", "a", "r", "1"),  # a Sunday
        ("2024-01-07", "s", "a", "q", "2"),
        ("2024-01-14", "s", "a", "r", "3"),
        ("2024-01-13", "s", "a", "r", "7"),  # a Saturday
    )
    assert rows(spend.weekday_profile(frame)) == [("0-Sunday", 2.0, 3), ("6-Saturday", 7.0, 1)]
    assert [r[0] for r in rows(spend.weekday_profile(frame, S.WEEKDAYS_PT))] == [
        "0-Domingo",
        "6-Sábado",
    ]
    with pytest.raises(ValueError):
        spend.weekday_profile(frame, ["Sunday"])


REPORTS = [
    spend.daily_spend,
    spend.monthly_spend,
    spend.excluded_months,
    spend.monthly_change,
    spend.region_ranking,
    spend.region_totals,
    spend.service_distribution,
    spend.weekday_profile,
]


@pytest.mark.parametrize("report", REPORTS)
def test_rollup_gives_the_same_as_lines(bills, rows, report):
    frame = bills(
        *days("2024-01-01", 25, "1.23"),
        *days("2024-01-03", 40, "4.567", "S3", "b"),
        ("2024-01-03", "S3", "eu", "b", "-2.5"),
    )
    assert rows(report(frame)) == rows(report(rollups.daily_rollup(frame)))


@pytest.mark.parametrize("report", [spend.top_resources, spend.top_resources_exact])
def test_resource_rollup_gives_the_same_as_lines(bills, rows, report):
    frame = bills(*days("2024-01-01", 5, "1.234"), *days("2024-01-01", 7, "2.005", "S3", "b"))
    assert rows(report(frame)) == rows(report(rollups.resource_rollup(frame)))


@pytest.mark.parametrize("report", [*REPORTS, spend.top_resources, spend.top_resources_exact])
def test_no_lines_no_rows(bills, rows, report):
    assert rows(report(bills(*days("2024-01-01", 1)).limit(0))) == []


def test_large_and_negative_costs_sum_exactly(bills, rows):
    frame = bills(
        ("2024-01-01", "s", "a", "r", "999999999999.999999"),
        ("2024-01-01", "s", "a", "r", "999999999999.999999"),
        ("2024-01-01", "s", "a", "r", "-1999999999999.5".replace("1999", "999")),
    )
    daily = rollups.daily_rollup(frame).collect()[0]
    assert daily[S.COST] == Decimal("1000000000000.499998")


def plain_months(bills, *by):
    """Distinct days counted by Spark, not from bits."""
    return bills.groupBy(*by, F.date_format(S.USAGE_DATE, "yyyy-MM").alias("month")).agg(
        F.round(F.sum(S.COST), 2).alias("total_cost"), F.countDistinct(S.USAGE_DATE).alias("days_with_data")
    )


def months_frame(bills):
    days = ["1969-12-31", "1970-01-01", "2000-02-29", "2024-01-31", "2024-02-01", "0001-01-01", "9999-12-31"]
    some = [(d, f"s{i % 2}", f"r{i % 3}", f"x{i}", f"{i}.115") for i, d in enumerate(days * 3)]
    whole = [(f"2023-{1 + i % 12:02d}-{1 + i % 28:02d}", "s0", "r1", f"y{i % 5}", "-1.005") for i in range(400)]
    return bills(*some, *whole)


@pytest.mark.parametrize("by", [(), (S.SERVICE,), (S.RESOURCE, S.REGION)])
def test_days_from_bits_equal_distinct_days(bills, rows, by):
    frame = months_frame(bills)
    assert sorted(rows(spend.all_months(frame, by))) == sorted(rows(plain_months(frame, *by)))


def test_month_states_can_be_merged(bills, rows):
    frame = months_frame(bills)
    by_region = spend.month_state(frame, [S.SERVICE, S.REGION])
    halves = spend.month_state(frame.filter("cost_usd < 0")).unionByName(spend.month_state(frame.filter("cost_usd >= 0")))
    expected = sorted(rows(spend.all_months(frame)))
    for states in (spend.merge_months(by_region), spend.merge_months(halves), spend.merge_months(spend.merge_months(by_region, [S.REGION]))):
        assert sorted(rows(spend.months_of(states))) == expected
