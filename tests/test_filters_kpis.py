import datetime as dt

from costlens.operators import kpis, spend
from costlens.operators.filters import date_bounds, facets, filter_bills

LINES = [
    ("2024-01-01", "EC2", "us", "a", "10"),
    ("2024-01-02", "EC2", "eu", "b", "20"),
    ("2024-01-04", "S3", "us", "c", "30"),
    ("2024-02-01", "S3", "eu", "d", "40"),
]


def resources(df):
    return sorted(r.resource_id for r in df.collect())


def test_filters_combine(bills):
    frame = bills(*LINES)
    assert resources(filter_bills(frame)) == ["a", "b", "c", "d"]
    assert resources(filter_bills(frame, service="S3")) == ["c", "d"]
    assert resources(filter_bills(frame, region="us")) == ["a", "c"]
    assert resources(filter_bills(frame, "S3", "eu")) == ["d"]


def test_date_range_is_inclusive_and_needs_both_ends(bills):
    frame = bills(*LINES)
    assert resources(filter_bills(frame, start="2024-01-02", end="2024-01-04")) == ["b", "c"]
    assert resources(filter_bills(frame, start=dt.date(2024, 1, 2), end="2024-02-01")) == [
        "b",
        "c",
        "d",
    ]
    assert len(resources(filter_bills(frame, start="2024-01-02"))) == 4
    assert len(resources(filter_bills(frame, end="2024-01-02"))) == 4


def test_facets_and_bounds(bills, rows):
    frame = bills(*LINES)
    assert rows(facets(frame)) == [
        ("region", "eu"),
        ("region", "us"),
        ("service", "EC2"),
        ("service", "S3"),
    ]
    assert rows(date_bounds(frame)) == [(dt.date(2024, 1, 1), dt.date(2024, 2, 1))]
    assert rows(date_bounds(frame.limit(0))) == []
    assert rows(facets(frame.limit(0))) == []


def month(first, cost, n=20):
    first = dt.date.fromisoformat(first)
    return [(first + dt.timedelta(days=i), "EC2", "us", "a", cost) for i in range(n)]


def test_kpis_take_filtered_lines_and_all_months(bills, rows):
    every = bills(*month("2024-01-01", "1"), *month("2024-02-01", "9", 3), *month("2024-03-01", "2"))
    frame = bills(*LINES)
    row = kpis.kpis(frame, spend.complete_months(every)).collect()[0]
    assert row.total_cost == 100.0
    assert row.daily_mean == 25.0
    assert row.top_service == "S3"
    assert row.month_change_pct == 100.0
    assert row.change_direction == "inverse"


def test_top_service_tie_goes_to_the_first_name(bills):
    frame = bills(("2024-01-01", "b", "us", "r", "5"), ("2024-01-01", "a", "us", "r", "5"))
    assert kpis.kpis(frame, spend.complete_months(frame)).collect()[0].top_service == "a"


def test_kpis_without_two_complete_months(bills, rows):
    frame = bills(*month("2024-01-01", "1"), *month("2024-02-01", "1", 19))
    indicators = kpis.kpis(frame, spend.complete_months(frame))
    row = indicators.collect()[0]
    assert (row.month_change_pct, row.change_direction) == (None, "off")
    assert kpis.kpi_texts(indicators).collect()[0].month_change == "N/A"


def test_kpi_texts_round_half_even(bills):
    frame = bills(*month("2024-01-01", "400"), *month("2024-02-01", "351"))
    row = kpis.kpi_texts(kpis.kpis(frame, spend.complete_months(frame))).collect()[0]
    assert row.month_change == "-12.2%"  # -12.25
    assert (row.total_cost, row.daily_mean) == ("$15,020", "$376")  # 375.5
    assert row.change_direction == "normal"


def test_no_lines_no_kpis(bills, rows):
    frame = bills(*LINES)
    assert rows(kpis.kpis(frame.limit(0), spend.complete_months(frame))) == []
