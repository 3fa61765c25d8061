import datetime as dt

import numpy as np
import pytest

from costlens import schema as S
from costlens.operators import forecast, spend


def series(costs, service="EC2", start=dt.date(2024, 1, 1)):
    """One line per day offset and cost."""
    return [
        (start + dt.timedelta(days=i), service, "us", "r", c)
        for i, c in (costs.items() if isinstance(costs, dict) else enumerate(costs))
    ]


def test_gaps_stay_gaps(bills, rows):
    frame = bills(*series({0: 1, 3: 2, 7: 4}))
    assert [(r[1], r[2]) for r in rows(forecast.trend_features(frame))] == [
        (1.0, 0),
        (2.0, 3),
        (4.0, 7),
    ]


def test_fit_and_forecast_equal_least_squares(bills, rows):
    costs = {0: 5.0, 1: 7.5, 2: 6.25, 5: 11.0, 9: 14.5}
    slope, intercept = np.polyfit(list(costs), list(costs.values()), 1)
    frame = bills(*series(costs))
    (fit,) = rows(forecast.trend_fit(frame))
    assert fit[:2] == pytest.approx((slope, intercept)) and fit[2] == 5
    future = rows(forecast.forecast(frame, 3))
    assert [d for d, _ in future] == [dt.date(2024, 1, d) for d in (11, 12, 13)]
    assert [c for _, c in future] == pytest.approx([intercept + slope * x for x in (10, 11, 12)])


def test_one_day_repeats(bills, rows):
    frame = bills(*series([8]))
    assert rows(forecast.trend_fit(frame)) == [(0.0, 8.0, 1)]
    assert {c for _, c in rows(forecast.forecast(frame))} == {8.0}
    assert len(rows(forecast.forecast(frame))) == 30


def test_falling_trend_stops_at_zero(bills, rows):
    future = rows(forecast.forecast(bills(*series([30, 20, 10])), 5))
    assert [c for _, c in future] == pytest.approx([0.0] * 5, abs=1e-9)
    assert min(c for _, c in future) >= 0


def test_projection_compares_with_last_rows(bills, rows):
    gappy = {2 * i: 10 for i in range(40)}  # the tail is 30 rows, not 30 days
    row = forecast.projection(bills(*series(gappy))).collect()[0]
    assert row.last_30_days == pytest.approx(300.0)
    assert row.predicted_total == pytest.approx(300.0)
    short = forecast.projection(bills(*series([10] * 10))).collect()[0]
    assert short.last_30_days == pytest.approx(100.0)
    assert short.change_pct == pytest.approx(200.0)
    assert (short.severity, short.sign) == ("red", "+")


def test_projection_of_falling_and_zero_costs(bills):
    falling = forecast.projection(bills(*series([40, 30, 20, 10])))
    row = forecast.projection_texts(falling).collect()[0]
    assert (row.severity, row.sign, row.change_text) == ("orange", "", "-100.0%")
    assert row.total_text == "$0"
    zero = forecast.projection(bills(*series([0, 0]))).collect()[0]
    assert zero.change_pct is None and zero.severity == "orange"


def test_series_joins_history_and_forecast(bills, rows):
    result = rows(forecast.trend_series(bills(*series([1, 2])), 2))
    assert [(r[0].day, r[2]) for r in result] == [
        (1, "actual"),
        (2, "actual"),
        (3, "forecast"),
        (4, "forecast"),
    ]
    assert [r[1] for r in result] == pytest.approx([1, 2, 3, 4])


def test_by_service_equals_filter_then_fit(bills, rows):
    first, second = series([1, 5, 2, 8]), series({0: 9, 4: 3}, "S3", dt.date(2024, 2, 1))
    both = bills(*first, *second)
    for service in ("EC2", "S3"):
        alone = both.filter(f"service = '{service}'")
        for operator in (
            forecast.trend_features,
            forecast.trend_fit,
            forecast.forecast,
            forecast.trend_series,
            forecast.projection,
        ):
            grouped = operator(both, by=["service"]).filter(f"service = '{service}'")
            assert rows(grouped.drop("service")) == rows(operator(alone))


@pytest.mark.parametrize(
    "operator",
    [
        forecast.trend_features,
        forecast.trend_fit,
        forecast.forecast,
        forecast.trend_series,
        forecast.projection,
    ],
)
def test_no_lines_no_rows(bills, rows, operator):
    assert rows(operator(bills(*series([1])).limit(0))) == []


def test_horizon_must_be_positive(bills):
    with pytest.raises(ValueError):
        forecast.forecast(bills(*series([1])), 0)


def test_fits_from_merged_month_states(bills):
    """Equal to fits of days: gaps, leap days, one day alone, credits, days shared by services."""
    days = ["1969-12-30", "1970-01-01", "2000-02-29", "2000-03-01", "2001-01-31", "2024-02-29"]
    frame = bills(
        *[(d, f"s{i % 2}", f"r{j}", "x", f"{(i * 37 + j) % 11 - 3}.1234567891") for i, d in enumerate(days * 2) for j in range(3)],
        ("2024-05-05", "alone", "r", "x", "7.5"),
    )
    states = spend.month_state(frame, [S.SERVICE, S.REGION])
    halves = spend.month_state(frame.filter("region = 'r0'")).unionByName(spend.month_state(frame.filter("region <> 'r0'")))
    late = frame.filter("usage_date >= '2000-01-01'")
    for got, lines, by in (
        (forecast.fit_of_months(states), frame, ()),
        (forecast.fit_of_months(halves), frame, ()),
        (forecast.fit_of_months(states, [S.SERVICE]), frame, (S.SERVICE,)),
        (forecast.fit_of_months(states.filter("month >= '2000-01'"), [S.REGION]), late, (S.REGION,)),
        (forecast.fit_of_months(states.filter("month > '3000'")), frame.limit(0), ()),
    ):
        want, got = sorted(forecast.trend_fit(lines, by).collect()), sorted(got.collect())
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert [pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x for x in b] == list(a)
