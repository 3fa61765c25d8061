import datetime as dt
import statistics

import pytest

from costlens.functions.joins import join_per_key
from costlens.operators import alerts, rollups


def line(day, service, resource, cost, region="us"):
    return (day, service, region, resource, cost)


def test_growth_threshold_is_inclusive(bills, rows):
    frame = bills(
        line("2024-01-10", "at", "r", "100"),
        line("2024-02-10", "at", "r", "120"),
        line("2024-01-10", "below", "r", "100"),
        line("2024-02-10", "below", "r", "119.99"),
        line("2024-02-10", "new", "r", "50"),
        line("2024-01-10", "gone", "r", "50"),
        line("2024-01-10", "zero", "r", "0"),
        line("2024-02-10", "zero", "r", "50"),
    )
    assert rows(alerts.growth_alerts(frame)) == [("Service growing", "at", 20.0, 100.0, 120.0)]


def test_growth_uses_latest_months_even_if_partial(bills, rows):
    lines = [line(dt.date(2024, m, d), "s", "r", m) for m in (1, 2) for d in range(1, 21)]
    frame = bills(*lines, line("2024-03-01", "s", "r", "1"))
    assert rows(alerts.growth_alerts(frame)) == []
    complete = alerts.growth_alerts(frame, complete_months_only=True)
    assert [r[2:] for r in rows(complete)] == [(100.0, 20.0, 40.0)]


def test_growth_needs_two_months_and_sorts_by_change(bills, rows):
    assert rows(alerts.growth_alerts(bills(line("2024-01-01", "s", "r", "1")))) == []
    frame = bills(
        *[line("2024-01-01", s, "r", "10") for s in "abc"],
        line("2024-02-01", "a", "r", "13"),
        line("2024-02-01", "b", "r", "20"),
        line("2024-02-01", "c", "r", "13"),
    )
    assert [r[1] for r in rows(alerts.growth_alerts(frame))] == ["b", "a", "c"]


def resources(service, costs):
    return [line("2024-01-01", service, f"{service}{i}", c) for i, c in enumerate(costs)]


def test_only_six_resources_can_have_an_outlier(bills, rows):
    frame = bills(
        *resources("two", [1, 1000]),
        *resources("five", [1, 1, 1, 1, 1000]),
        *resources("six", [1, 1, 1, 1, 1, 1000]),
    )
    found = rows(alerts.outlier_alerts(frame))
    assert [r[1] for r in found] == ["six5"]
    assert found[0][3:] == (1000.0, 167.5)
    assert [r[0] for r in rows(alerts.service_cost_stats(frame))] == ["five", "six"]


def test_equal_costs_are_no_outliers(bills, rows):
    assert rows(alerts.outlier_alerts(bills(*resources("s", ["0.7"] * 9)))) == []


def test_outliers_sum_over_regions_and_keep_the_costliest(bills, rows):
    split = [line("2024-01-01", "s", "big", 50, g) for g in ("us", "eu")]
    frame = bills(*split, *resources("s", [1] * 9), *resources("t", [1] * 9 + [500]))
    assert [(r[1], r[3]) for r in rows(alerts.outlier_alerts(frame))] == [
        ("t9", 500.0),
        ("big", 100.0),
    ]
    assert [r[1] for r in rows(alerts.outlier_alerts(frame, top_n=1))] == ["t9"]
    rolled = rollups.resource_rollup(frame)
    assert rows(alerts.outlier_alerts(rolled)) == rows(alerts.outlier_alerts(frame))


def test_outliers_equal_brute_force_with_a_hot_service(spark, bills, rows):
    """Most resources in one service, joined both broadcast and shuffled."""
    lines = resources("hot", [(i * 37) % 101 + (900 if i % 97 == 0 else 0) for i in range(800)])
    for s in range(8):
        lines += resources(f"s{s}", [(i * 13 + s) % 17 + (99 if i == s else 0) for i in range(12)])
    expected = set()
    for service in {x[1] for x in lines}:
        costs = {x[3]: float(x[4]) for x in lines if x[1] == service}
        limit = statistics.mean(costs.values()) + 2 * statistics.stdev(costs.values())
        expected |= {r for r, c in costs.items() if c > limit}
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            found = rows(alerts.outlier_alerts(bills(*lines), top_n=None))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {r[1] for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("salt_bits", [0, 1, 6])
def test_join_per_key_is_an_inner_join(spark, salt_bits):
    left = spark.range(200).selectExpr("id", "case when id < 150 then 'hot' else 'k' || id % 7 end k")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, v int")
    joined = join_per_key(left, right, "k", "id", salt_bits)
    plain = left.join(right, "k")
    assert sorted(joined.select("k", "id", "v").collect()) == sorted(
        plain.select("k", "id", "v").collect()
    )


def feed_lines():
    return [
        line("2024-01-01", "up", "r", "1000"),
        line("2024-02-01", "up", "r", "1250.5"),
        *resources("s", [1] * 9 + [4321.5]),
        *[line("2024-02-01", "s", f"s{i}", 1) for i in range(10)],
    ]


def test_feed_puts_growth_first(bills, rows):
    feed = alerts.alert_feed(bills(*feed_lines()))
    assert [(r.family_rank, r.service, r.resource_id) for r in feed.collect()] == [
        (1, "up", None),
        (2, "s", "s9"),
    ]


def test_card_texts(bills, rows):
    frame = bills(*feed_lines())
    cards = rows(alerts.alert_cards(alerts.alert_feed(frame)))
    assert cards == [
        (1, "Service growing", "up grew 25.0%", "From $1,000.00 to $1,250.50 in the last month", "red"),
        (2, "Resource outlier", "s9 (s)", "Cost of $4,322.50 — service mean: $434.05", "orange"),
    ]
    pt = alerts.PORTUGUESE
    cards = rows(alerts.alert_cards(alerts.alert_feed(frame, wording=pt), wording=pt))
    assert [c[1:4] for c in cards] == [
        ("Serviço em alta", "up cresceu 25.0%", "De $1,000.00 para $1,250.50 no último mês"),
        ("Recurso outlier", "s9 (s)", "Gasto de $4,322.50 — média do serviço: $434.05"),
    ]
    assert len(rows(alerts.alert_cards(alerts.alert_feed(frame), n=1))) == 1


def test_no_lines_no_alerts(bills, rows):
    frame = bills(line("2024-01-01", "s", "r", "1")).limit(0)
    for operator in (
        alerts.growth_alerts,
        alerts.outlier_alerts,
        alerts.service_cost_stats,
        alerts.alert_feed,
        alerts.month_service_spend,
    ):
        assert rows(operator(frame)) == []
